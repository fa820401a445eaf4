"""The queries of this subpackage, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import chat_format, read_formatted, threads
from .collocations import collocations
from .common import discard_folders, materialize, new_path, prepare
from .language_id import language_id
from .manifest import merkle_manifest, without_line_ends
from .mixing import mix_to_weights
from .ngram_join import ngram_jaccard_components
from .oracles import ORACLES  # noqa: F401
from .packing import pack_sequences
from .pipeline import MIX_WEIGHTS, mix_levels, run
from .quality_rules import quality_rules
from .sharding import shard_documents
from .substring_dedup import repeated_passages
from .token_files import token_files
from .topk import exact_top_k
from .warc import fixity_audit, warc_records, write_replica

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents")).withColumn("n_spans", F.size("spans")).drop("spans")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mix_to_weights(docs, mix_levels(), MIX_WEIGHTS, amount=0.8, epochs=2).select("doc_id", "lang", "source", "n_tokens", "copies")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of words that repeat a passage, and the places that stay."""
    return repeated_passages(_table(spark, sf_dir, "documents")).drop("text_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_sequences(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two replicas of all pages as WARC files; in the second, bytes of one record in 1009 are changed."""
    records = warc_records(_table(spark, sf_dir, "pages"))
    ours, theirs = new_path(spark, "warc-ours"), new_path(spark, "warc-theirs")
    write_replica(records, ours)
    hit = F.coalesce(F.pmod("page_id", F.lit(1009)) == 5, F.lit(False))
    write_replica(records.withColumn("record", F.when(hit, F.regexp_replace("record", "^WARC/1.0", "WARC/1.!")).otherwise(F.col("record"))), theirs)
    audit = fixity_audit(spark, ours, theirs)
    discard_folders(ours, theirs)
    page = F.regexp_extract("record_id", "page:(-?[0-9]+)", 1)
    return audit.select(F.when(page != "", page).cast("long").alias("page_id"), "volume", "seq", F.col("offset").alias("byte_offset"), F.col("length").alias("byte_length"), F.col("hash").alias("sha256_hex"), "damaged")


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    nodes = materialize(threads(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)), "nodes")
    formatted = materialize(chat_format(nodes), "formatted")
    back = read_formatted(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    tree = F.col("conversation.tree")
    read = back.select(F.when(tree != "", tree).cast("long").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "conversation")
    return read.join(formatted.select("conversation", F.length("formatted").cast("long").alias("formatted_chars")), "conversation").drop("conversation")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents under the law ``rows``: counts at most one apart."""
    found = shard_documents(_table(spark, sf_dir, "documents"), shards=16)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "group_rows")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, proved against leaves half of which have lost the line ends of their text."""
    docs = _table(spark, sf_dir, "documents")
    claim = without_line_ends(F.col("doc_id"), F.col("text"), *[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")])
    return merkle_manifest(docs, claim=claim).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_packing": op6_packing,
    "op7_token_files": op7_token_files,
    "op8_warc_audit": op8_warc_audit,
    "op9_chat_format": op9_chat_format,
    "op10_topk": op10_topk,
    "op11_sharding": op11_sharding,
    "op12_collocations": op12_collocations,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": run,
}
