"""WARC files and their Merkle fixity audit.

A replica is a folder of gzip'd WARC files, one for each volume of records. Records are hashed, and ordered ranges of
offsets form a tree of SHA-256 hashes over all volumes. Two replicas are compared from the root: only branches whose
hashes differ are descended, down to the damaged records.
"""

from __future__ import annotations

import contextlib
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, plain, tidy

#: Pages of a range of page_id that one task writes, bytes after which the next volume begins, volumes of a range at
#: most, and children of a node.
RANGE, VOLUME_BYTES, PARTS, FANOUT = 2048, 64 << 20, 1 << 20, 16


def warc_records(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as WARC resource records: volume, seq (their order), page_id, record.

    A volume is the next records of a range of RANGE page_ids, up to VOLUME_BYTES and one record more; its number is the
    range's times PARTS, and on from there. Pages without an id are spread by hash over as many negative ranges as they
    fill. Records go by page_id, url and html; repeated rows are records of their own. A null url or html is empty; line
    breaks in a url are percent-encoded. The record ends in two line breaks. All of a volume is in one partition.
    """
    rows = plain(pages, "page_id", "url", "html")
    spread = max(1, -(-rows.filter("page_id IS NULL").count() // RANGE))
    html = F.coalesce("html", F.lit(""))
    uri = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    rows = rows.withColumn("range", F.coalesce(F.floor(F.col("page_id") / RANGE), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(spread))))
    order = Window.partitionBy("range").orderBy(F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), F.col("html").asc_nulls_first())
    before = F.sum(F.octet_length(F.concat(head, html)).cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    part = F.floor(F.coalesce(before, F.lit(0)) / VOLUME_BYTES)
    return rows.select((F.col("range") * PARTS + part).alias("volume"), (F.row_number().over(order) - 1).alias("seq"), "page_id", F.concat(head, html, F.lit("\r\n\r\n")).alias("record"))


def write_replica(records: DataFrame, folder: str) -> None:
    """Write records (volume, seq, record) as one gzip'd file a volume, in the order of seq. All of a volume must be in
    one partition, as ``warc_records`` gives them, so nothing is shuffled here."""
    # Spark's text writer ends each line with lineSep, which is here the end of the record
    lines = records.select("volume", "seq", F.expr("substring(record, 1, length(record) - 2)").alias("value"))
    lines.sortWithinPartitions("volume", "seq").drop("seq").write.partitionBy("volume").option("lineSep", "\r\n").option("compression", "gzip").text(folder)


def _volumes(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select(F.regexp_extract("path", "volume=(-?[0-9]+)", 1).cast("long").alias("volume"), "content")


def parse_warc(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """Offset and length of each record, and its record id; trailing bytes that form no record are one more. Header names
    are alike in any case."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].split(b"\r\n")[1:] if end >= 0 and data.startswith(b"WARC/", at) else []
        fields = {name.strip().lower(): value.strip() for name, colon, value in (x.partition(b":") for x in lines) if colon}
        size = fields.get(b"content-length", b"")
        stop = end + 4 + int(size) + 4 if size.isdigit() else len(data)
        yield at, min(stop, len(data)) - at, fields.get(b"warc-record-id", b"")
        at = min(stop, len(data))


def _unzipped(content: bytes) -> tuple[bytes, bytes]:
    """What decompresses of a gzip'd volume before an error, and the rest of the file: bytes that are no whole gzip
    member, or empty. Members may follow each other, as many as there are records."""
    parts, begin = [], 0
    while begin < len(content):
        one, at = zlib.decompressobj(31), begin
        while not one.eof and at < len(content):
            chunk = content[at : at + 1024]
            try:
                parts.append(one.decompress(chunk))
            except zlib.error:
                # byte by byte from where the chunk begins, to lose none before the error
                one = zlib.decompressobj(31)
                one.decompress(content[begin:at])
                with contextlib.suppress(zlib.error):
                    for k in range(len(chunk)):
                        parts.append(one.decompress(chunk[k : k + 1]))
                return b"".join(parts), content[begin:]
            at += len(chunk)
        if not one.eof:
            return b"".join(parts), content[begin:]
        begin = at - len(one.unused_data)
    return b"".join(parts), b""


@tidy
def _manifest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["volume", "seq", "record_id", "offset", "length", "hash"]
    for batch in batches:
        for volume, content in zip(batch.column("volume").to_pylist(), batch.column("content"), strict=True):
            data, broken = _unzipped(content.as_py() or b"")
            rows = [(volume, k, rid.decode("utf-8", "replace"), at, size, hashlib.sha256(memoryview(data)[at : at + size]).hexdigest()) for k, (at, size, rid) in enumerate(parse_warc(data))]
            if broken:
                rows.append((volume, len(rows), "", len(data), 0, hashlib.sha256(broken).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The records of a replica: volume, seq, record_id, offset, length, hash (SHA-256 of the record's bytes). A file may be
    one gzip member or many. Where one breaks, the records before are listed, and the bytes from its first one on are one
    more without an id and of no length."""
    return _volumes(spark, folder).mapInArrow(_manifest, "volume long, seq long, record_id string, offset long, length long, hash string")


@tidy
def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for volume, content, ranges in zip(batch.column("volume").to_pylist(), batch.column("content"), batch.column("ranges").to_pylist(), strict=True):
            data, broken = _unzipped(content.as_py() or b"")
            rows = [(volume, r["seq"], r["offset"], r["length"], hashlib.sha256(memoryview(data)[r["offset"] : r["offset"] + r["length"]]).hexdigest()) for r in ranges or []]
            end = max((r["offset"] + r["length"] for r in ranges or []), default=0)
            if len(data) > end or broken or not ranges:
                rest = data[end:]
                rows.append((volume, len(rows), end, len(rest), hashlib.sha256(rest + broken).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (*[pa.int64()] * 4, pa.string()), strict=True)], ["volume", "seq", "offset", "length", "hash"])


def hash_ranges(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Hashes of the offset ranges that ``expected`` (volume, seq, offset, length) names, in another replica.

    A missing volume hashes as empty, and so does what comes after an error of decompression. Bytes after the last range,
    a broken end of a file, and volumes that ``expected`` doesn't have are one more range of their volume, to its end.
    """
    ranges = expected.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("seq", "offset", "length"))).alias("ranges"))
    return ranges.join(_volumes(spark, folder), "volume", "full").select("volume", "content", "ranges").mapInArrow(_ranges, "volume long, seq long, offset long, length long, hash string")


def _up(level: DataFrame, number: int, inner: int, base: int) -> DataFrame:
    """A level with the key of each node's parent: within its volume, then among all volumes."""
    place = F.col("volume") - base if number == inner else F.col("node")
    return level.withColumns({"up_volume": F.col("volume") if number < inner else F.lit(base), "up_node": F.floor(place / FANOUT)})


def _steps(top: int) -> int:
    steps = 1
    while top := top // FANOUT:
        steps += 1
    return steps


def merkle_trees(*replicas: DataFrame) -> list[list[DataFrame]]:
    """Trees over the ranges (volume, seq, offset, length, hash) of replicas, as levels from the leaves up to one root:
    volume, node, hash, first_offset, end_offset and the parent's key. Trees have as many levels as the largest needs:
    within each volume first, then over all volumes. A node's hash is over its children's keys, ranges and hashes, in
    order."""
    most = [r.agg(F.max("seq"), F.min("volume"), F.max("volume")).first() for r in replicas]
    most = [m for m in most if m[0] is not None] or [(0, 0, 0)]
    base = min(m[1] for m in most)
    inner = _steps(max(m[0] for m in most))
    height = inner + _steps(max(m[2] for m in most) - base)
    trees = []
    for hashes in replicas:
        leaves = hashes.select("volume", F.col("seq").alias("node"), "hash", F.col("offset").alias("first_offset"), (F.col("offset") + F.col("length")).alias("end_offset"))
        levels = [_up(leaves, 0, inner, base)]
        for number in range(1, height + 1):
            child = F.struct("volume", "node", "hash", "first_offset", "end_offset")
            up = levels[-1].groupBy("up_volume", "up_node").agg(F.array_sort(F.collect_list(child)).alias("children"))
            text = F.array_join(F.transform("children", lambda c: F.concat_ws(":", c["volume"].cast("string"), c["node"].cast("string"), c["hash"], c["first_offset"].cast("string"), c["end_offset"].cast("string"))), "|")
            level = up.select(F.col("up_volume").alias("volume"), F.col("up_node").alias("node"), F.sha2(text, 256).alias("hash"), F.col("children")[0]["first_offset"].alias("first_offset"), F.element_at("children", -1)["end_offset"].alias("end_offset"))
            levels.append(materialize(_up(level, number, inner, base), "merkle"))
        trees.append(levels)
    return trees


def damaged_leaves(ours: list[DataFrame], theirs: list[DataFrame]) -> DataFrame:
    """Leaves (volume, node) whose hashes differ, found from the roots down through mismatching branches only."""
    key = ["volume", "node"]
    if [r.hash for r in ours[-1].select("hash").collect()] == [r.hash for r in theirs[-1].select("hash").collect()]:
        return ours[-1].limit(0).select(*key)
    suspects = ours[-1].select(*key).unionByName(theirs[-1].select(*key)).distinct()
    for a, b in zip(ours[-2::-1], theirs[-2::-1], strict=True):
        under = suspects.toDF("up_volume", "up_node")
        own = [x.join(under, ["up_volume", "up_node"], "left_semi").select(*key, "hash") for x in (a, b)]
        # each level is written, or the plan would hold all above it twice
        differ = own[0].join(own[1].withColumnRenamed("hash", "other"), key, "full").filter(~F.col("hash").eqNullSafe(F.col("other")))
        suspects = materialize(differ.select(*key), "suspects")
    return suspects


def fixity_audit(spark: SparkSession, ours: str, theirs: str) -> DataFrame:
    """Audit a replica against ours: volume, seq, record_id, offset, length, hash, damaged (boolean), one row a record.

    Every record is hashed in both; the comparison descends only mismatching branches of the trees. Records of the other
    replica are cut at our offsets, so damage to a header does not hide what follows; where a gzip file breaks, records
    before the break are whole. What the other replica has beyond our records, at the end of a volume or as a volume of
    its own, is a damaged row without record_id, with its own offset, length and hash. Two empty replicas have no rows.
    """
    listed = materialize(manifest(spark, ours), "manifest")
    other = materialize(hash_ranges(spark, theirs, listed), "ranges")
    trees = merkle_trees(listed, other)
    bad = damaged_leaves(*trees).select("volume", F.col("node").alias("seq"), F.lit(True).alias("damaged"))
    rows = listed.join(bad, ["volume", "seq"], "left").select("volume", "seq", "record_id", "offset", "length", "hash", F.coalesce("damaged", F.lit(False)).alias("damaged"))
    extra = other.join(bad, ["volume", "seq"]).join(listed.select("volume", "seq"), ["volume", "seq"], "left_anti")
    out = materialize(rows.unionByName(extra.select("volume", "seq", F.lit(None).cast("string").alias("record_id"), "offset", "length", "hash", "damaged")), "audit")
    discard(listed, other, *trees[0][1:], *trees[1][1:])
    return out
