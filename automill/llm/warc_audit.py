"""Fixity audit of web archives with Merkle trees.

Every record is hashed where it is read. Records are grouped by the range of ``RANGE`` bytes that their
offset lies in; a range's node hashes its records' (offset, length, digest) in order, and a node of the
next level the nodes of ``FANOUT`` ranges, up to one root for each archive. Payloads never leave their
task: only digests are exchanged, and no task gathers more than a range's records or a node's
children. To compare two replicas, roots are compared first and only branches that differ are
followed down; of the ranges that differ, the records are compared.

Edge cases: a null payload is hashed as empty; records at equal offsets of an archive are one leaf of
sorted digests; a null archive is an archive of its own; an archive that one replica lacks is reported
record by record; empty tables give an empty result; other columns pass by.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from automill.llm.scratch import keep

#: Bytes of a leaf range, and children of a node. An archive of half a megabyte has three levels, one of a gigabyte six.
RANGE, FANOUT = 1 << 16, 8
#: Compressed bytes that are unpacked at a time.
_CHUNK = 1 << 16
#: Pages of an archive that ``archive_pages`` writes.
PAGES = 256


def warc_record(url: Column, payload: Column, record_id: Column) -> Column:
    """A WARC response record: header lines, an empty line, the payload, two line ends."""
    end = F.lit("\r\n")
    body = F.coalesce(payload, F.lit(""))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"), end,
        F.lit("WARC-Target-URI: "), F.coalesce(url, F.lit("")), end, F.lit("Content-Type: text/html"), end,
        F.lit("Content-Length: "), F.octet_length(body).cast("string"), end, end,
    )
    return F.concat(head, body, end, end)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Lay pages out in archives of ``PAGES`` consecutive ids: archive, offset, length, id and sha256 of the record.

    The record's bytes are hashed in place; the running offsets are made from lengths alone.
    """
    record = warc_record(F.col(url_col), F.col(html_col), F.col(id_col)).cast("binary")
    rows = pages.select(
        F.floor(F.col(id_col) / PAGES).cast("long").alias("archive"),
        F.col(id_col).alias("id"),
        F.octet_length(record).cast("long").alias("length"),
        F.sha2(record, 256).alias("sha256"),
    )
    before = Window.partitionBy("archive").orderBy("id", "sha256").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))


def aligned(replica: DataFrame, records: DataFrame) -> DataFrame:
    """A replica's records at the offsets that records with their archive and id have in the first copy.

    Damage that changes a record's length, or a lost record, moves all that stand behind it; these are no differences.
    Records that repeat an id are taken in order. One that the first copy lacks stands at minus its offset, less one.
    """
    nth = F.row_number().over(Window.partitionBy("archive", "id").orderBy("offset"))
    places = records.select(F.col("archive").alias("archive_"), F.col("id").alias("id_"), nth.alias("nth_"), F.col("offset").alias("offset_"))
    rows = replica.withColumn("nth", nth)
    same = F.col("archive").eqNullSafe(F.col("archive_")) & F.col("id").eqNullSafe(F.col("id_")) & (F.col("nth") == F.col("nth_"))
    offset = F.coalesce("offset_", -1 - F.col("offset")).alias("offset")
    return rows.join(places, same, "left").select("archive", "id", "length", "sha256", offset)


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.DOTALL)
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*([^\r\n]*)", re.MULTILINE)


def parse_warc(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, header fields, payload) of each record of an uncompressed archive."""
    at = 0
    while m := _HEAD.search(data, at):
        fields = {k.decode().lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(m[1])}
        size = int(fields.get("content-length", "0"))
        end = min(len(data), m.end() + size + 4)
        yield m.start(), end - m.start(), fields, data[m.end() : m.end() + size]
        at = end


def parse_warc_gz(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """As parse_warc, of an archive with a gzip member for each record: offset and length are the member's, as indexes of such archives name them.

    A member that holds no record, or ends before its data does, has no fields and what could be unpacked as its payload.
    """
    at = 0
    while at < len(data):
        unpack, out, fed = zlib.decompressobj(31), [], at
        try:
            while not unpack.eof and fed < len(data):
                out.append(unpack.decompress(data[fed : fed + _CHUNK]))
                fed = min(len(data), fed + _CHUNK)
            end = fed - len(unpack.unused_data)
        except zlib.error:  # what is left is no member, and one damaged record
            end = len(data)
        record = b"".join(out)
        _, _, fields, payload = next(parse_warc(record), (0, 0, {}, record))
        yield at, end - at, fields, payload
        at = end


def read_archives(files: DataFrame) -> DataFrame:
    """Records of whole files as read by Spark's binaryFile source: archive, offset, length, sha256.

    Files may be plain or have a gzip member for each record; the digest is that of the bytes as they are stored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                content = content or b""
                parse = parse_warc_gz if content.startswith(b"\x1f\x8b") else parse_warc
                rows += [(path, o, n, hashlib.sha256(memoryview(content)[o : o + n]).hexdigest()) for o, n, _, _ in parse(content)]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["archive", "offset", "length", "sha256"])

    return files.select("path", "content").mapInArrow(run, "archive string, offset long, length long, sha256 string")


def _node(parts: Column) -> Column:
    return F.sha2(F.to_json(F.sort_array(F.collect_list(parts))).cast("binary"), 256)


def merkle_levels(records: DataFrame) -> list[DataFrame]:
    """Tables of nodes (archive, node, hash), leaf ranges first, roots last."""
    leaf = records.groupBy("archive", F.floor(F.col("offset") / RANGE).alias("node"))
    levels = [keep(leaf.agg(_node(F.struct("offset", "length", "sha256")).alias("hash")), "warc-ranges")]
    last = levels[0].agg(F.max("node")).first()[0] or 0
    while last:
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up"))
        levels.append(keep(up.agg(_node(F.struct("node", "hash")).alias("hash")).withColumnRenamed("up", "node"), "warc-nodes"))
        last //= FANOUT
    return levels


def _lift(levels: list[DataFrame], n: int) -> list[DataFrame]:
    """Levels up to n, by giving the last ones parents of one child."""
    while len(levels) < n:
        up = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("up"))
        levels = [*levels, keep(up.agg(_node(F.struct("node", "hash")).alias("hash")).withColumnRenamed("up", "node"), "warc-nodes")]
    return levels


def _differ(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys whose hash differs or that one side lacks."""
    right = b.select(*[F.col(c).alias(f"{c}_") for c in b.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    both = a.join(right, same, "full")
    missing = [F.when(F.col("hash").isNull(), F.col(f"{k}_")).otherwise(F.col(k)).alias(k) for k in keys]
    return both.where(~F.col("hash").eqNullSafe(F.col("hash_"))).select(*missing)


def audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records (archive, offset, status) in which replicas a and b differ: changed, missing (from b) or extra (in b)."""
    trees = [merkle_levels(r.select("archive", "offset", "length", "sha256")) for r in (a, b)]
    height = max(map(len, trees))
    trees = [_lift(t, height) for t in trees]
    bad = None
    for level in range(height - 1, -1, -1):
        sides = [t[level] for t in trees]
        if bad is not None:
            parent = F.broadcast(bad) if bad.count() <= 100_000 else bad
            sides = [s.join(parent, s["archive"].eqNullSafe(parent["archive_"]) & (F.floor(s["node"] / FANOUT) == parent["node_"]), "left_semi") for s in sides]
        bad = keep(_differ(*sides, "archive", "node").select(F.col("archive").alias("archive_"), F.col("node").alias("node_")), "warc-bad")
    leaves = []
    for r in (a, b):
        inside = r.join(bad, r["archive"].eqNullSafe(bad["archive_"]) & (F.floor(r["offset"] / RANGE) == bad["node_"]), "left_semi")
        leaves.append(inside.groupBy("archive", "offset").agg(_node(F.struct("length", "sha256")).alias("hash")))
    left, right = leaves
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    both = left.join(right, left["archive"].eqNullSafe(right["archive_"]) & (left["offset"] == right["offset_"]), "full")
    both = both.where(~F.col("hash").eqNullSafe(F.col("hash_")))
    status = F.when(F.col("hash").isNull(), "extra").when(F.col("hash_").isNull(), "missing").otherwise("changed")
    gone = F.col("hash").isNull()
    return both.select(
        F.when(gone, F.col("archive_")).otherwise(F.col("archive")).alias("archive"),
        F.when(gone, F.col("offset_")).otherwise(F.col("offset")).alias("offset"),
        status.alias("status"),
    )
