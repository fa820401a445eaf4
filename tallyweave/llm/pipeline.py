"""The corpus pipeline: quality rules, n-gram join, substring dedup, mixing, packing.

Each stage takes all that the one before kept, and is written as Parquet and read again for the next. Every stage keeps
rows with odd values: null texts and ids pass the second and third stage, repeated rows are judged alike, ties go to
the smaller doc_id, and an empty table gives an empty table. All but the last return the columns of their input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, prepare
from .mixing import mix_to_weights
from .ngram_join import keep_one_of_each_component
from .packing import pack_sequences
from .quality_rules import keep_good_documents
from .substring_dedup import remove_repeats

#: Levels of the mixing tree over documents, and weights of its nodes among their siblings.
MIX_WEIGHTS: dict[tuple[str, ...], float] = {("domain0",): 4.0, ("domain1",): 3.0, ("domain2",): 2.0, ("domain3",): 1.0} | {(f"domain{k}", "en"): 3.0 for k in range(4)}


def mix_levels() -> dict[str, Column]:
    domain = F.concat(F.lit("domain"), F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(4)).cast("string"))
    return {"domain": domain, "language": F.col("lang"), "origin": F.col("source")}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the isolation forest keep; null and wordless texts fail the base rules."""
    prepare(spark)
    return keep_good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word similarity of 0.8 or more: the one with the smallest doc_id, once.
    Null doc_ids and wordless texts stay."""
    prepare(spark)
    return keep_one_of_each_component(docs, width=5, num=80, den=100)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand elsewhere before; documents of which nothing is left go."""
    prepare(spark)
    return remove_repeats(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One epoch at most, nine tenths of the tokens, near the target weights; null languages and sources are leaves."""
    prepare(spark)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # whose columns may have any name
    return mix_to_weights(docs.select("doc_id", "text", "lang", "source", row), mix_levels(), MIX_WEIGHTS, amount=0.9, epochs=1).filter("copies > 0").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, as in op6_packing; a null text has its end id only."""
    prepare(spark)
    import public_tokenizers

    pieces = pack_sequences(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("passages", passages),
    ("mixture", mixture),
    ("packed", packed),
]

#: The stages train a forest and follow links to components of any size, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents`` of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
