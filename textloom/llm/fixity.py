"""WARC records and a Merkle fixity audit of two replicas."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.base import durable, release

#: Children of a node, and levels above the records: a file holds at most FANOUT ** LEVELS records.
FANOUT, LEVELS = 16, 4


def record(url: Column, body: Column) -> Column:
    """Bytes of one WARC/1.1 response record (as text); null parts count as empty."""
    body, url = F.coalesce(body, F.lit("")), F.coalesce(url, F.lit(""))
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def members(data: bytes) -> Iterator[tuple[bytes, bool]]:
    """The unpacked gzip members of a file, each a stream of whole records, and whether it is raw bytes that do not unpack."""
    good = []
    while data:
        z = zlib.decompressobj(31)
        try:
            out = z.decompress(data) + z.flush()
        except zlib.error:
            break
        good.append(out)
        data = z.unused_data
    if good:
        yield b"".join(good), False
    if data:
        yield data, True


def records(data: bytes) -> Iterator[bytes]:
    """The records of an unpacked WARC stream, each with the blank lines after it; together they are all bytes of it."""
    at = 0
    while at < len(data):
        head = data.find(b"\r\n\r\n", at)
        sizes = [x.split(b":", 1)[1].strip() for x in data[at : max(head, at)].split(b"\r\n") if x.lower().startswith(b"content-length:")]
        if head >= 0 and sizes and sizes[0].isdigit():
            end = min(len(data), head + 4 + int(sizes[0]) + 4)
        else:
            found = data.find(b"\nWARC/", at + 1)
            end = found + 1 if found >= 0 else len(data)
        yield data[at:end]
        at = end


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """file, seq, pos, record (binary) of the WARC files under a path, plain or one gzip member a record; whole files are read by Spark's binary source, one file a row.

    pos is the record's offset in the decompressed stream. Damage never ends the reading: a file that ends within a record gives the part that is there, a gzip member that does not unpack gives its raw bytes and all after them as one record,
    and a record whose head has no usable Content-Length reaches to the next line that begins with WARC/, or to the end. An empty file gives no rows.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, data in zip(frame["path"], frame["content"], strict=True):
                data = bytes(data)
                rows, at = [], 0
                for stream, broken in members(data) if data[:2] == b"\x1f\x8b" else [(data, False)]:
                    for part in [stream] if broken else records(stream):
                        rows.append((name, len(rows), at, part))
                        at += len(part)
                yield pd.DataFrame(rows, columns=["file", "seq", "pos", "record"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, seq long, pos long, record binary")


def digested(body: Column) -> Column:
    """size and digest (SHA-256) of a record's bytes: all that the tree needs of them. A null record counts as empty."""
    body = F.coalesce(body.cast("binary"), F.lit(b""))
    return F.struct(F.octet_length(body).cast("long").alias("size"), F.sha2(body, 256).alias("digest"))


def leaves(records: DataFrame) -> DataFrame:
    """file, seq, pos, size, hash of records file, seq, pos, record."""
    return leaves_of_digests(records.select("file", "seq", "pos", digested(F.col("record")).alias("x")).select("file", "seq", "pos", "x.size", "x.digest"))


def leaves_of_digests(records: DataFrame) -> DataFrame:
    """file, seq, pos, size, hash of records file, seq, pos, size, digest. The leaf hashes offset, size and bytes, so a moved record shows too."""
    return records.select("file", "seq", "pos", "size", F.sha2(F.concat_ws(":", "pos", "size", "digest"), 256).alias("hash"))


def tree(leaf: DataFrame) -> list[DataFrame]:
    """Levels 0 (records) to LEVELS (a root for each file) as file, node, hash; a node is the hash of its at most FANOUT children in order of offset ranges."""
    levels = [leaf.select("file", F.col("seq").alias("node"), "hash")]
    for _ in range(LEVELS):
        below = levels[-1]
        parts = below.groupBy("file", F.floor(F.col("node") / FANOUT).alias("node")).agg(F.array_sort(F.collect_list(F.struct("node", "hash"))).alias("c"))
        levels.append(parts.select("file", "node", F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["node"], x["hash"])), ";"), 256).alias("hash")))
    return levels


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """file, seq, pos_left, size_left, hash_left, pos_right, size_right, hash_right and state (changed, missing on the left, missing on the right) of every record in which two replicas differ.

    The roots of all files are compared first; each next level is compared below mismatching nodes only. Equal or empty replicas give no rows. Rows with a null file or seq are not audited;
    of records that share file and seq the least leaf hash stands for all. seq counts a file's records from 0 and stays below FANOUT ** LEVELS.
    """
    return audit_leaves(leaves(left), leaves(right))


def audit_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """audit of replicas whose records are leaves already."""
    side = []
    for k, records in (("l", left), ("r", right)):
        leaf = records.where("file is not null and seq is not null").groupBy("file", "seq").agg(F.min(F.struct("hash", "pos", "size")).alias("x")).select("file", "seq", "x.pos", "x.size", "x.hash")
        side.append(durable(leaf, f"leaves-{k}"))
    a, b = (tree(x) for x in side)
    open_nodes = None
    for level in range(LEVELS, -1, -1):
        x, y = a[level].withColumnRenamed("hash", "hl"), b[level].withColumnRenamed("hash", "hr")
        if open_nodes is not None:
            x, y = (z.withColumn("up", F.floor(F.col("node") / FANOUT)).join(open_nodes, ["file", "up"], "left_semi").drop("up") for z in (x, y))
        bad = x.join(y, ["file", "node"], "full").where(~F.col("hl").eqNullSafe(F.col("hr")))
        open_nodes = durable(bad.select("file", F.col("node").alias("up")), f"level-{level}")
    bad = open_nodes.withColumnRenamed("up", "seq")
    named = (x.join(bad, ["file", "seq"], "left_semi").select("file", "seq", F.col("pos").alias(f"pos_{n}"), F.col("size").alias(f"size_{n}"), F.col("hash").alias(f"hash_{n}")) for x, n in zip(side, ("left", "right"), strict=True))
    out = next(named).join(next(named), ["file", "seq"], "full")
    state = F.when(F.col("hash_left").isNull(), "missing on the left").when(F.col("hash_right").isNull(), "missing on the right").otherwise("changed")
    return out.withColumn("state", state)


def page_records(pages: DataFrame) -> DataFrame:
    """page_id, record of pages; a page id stands for at most one record, the first by url and html. The pages' bytes are shuffled for this."""
    one = pages.where("page_id is not null").groupBy("page_id").agg(F.min(F.struct("url", "html")).alias("x"))
    return one.select("page_id", record(F.col("x.url"), F.col("x.html")).alias("record"))


def placed(rows: DataFrame, per_file: int = 1000) -> DataFrame:
    """rows page_id, size and others with file, seq, pos of their records, in order of page_id, per_file ids a file."""
    n = F.floor(F.col("page_id") / per_file)
    w = Window.partitionBy(n).orderBy("page_id")
    file = F.concat(F.lit("warc-"), F.lpad(n.cast("string"), 8, "0")).alias("file")
    return rows.select("*", file, (F.row_number().over(w) - 1).cast("long").alias("seq"), (F.sum("size").over(w) - F.col("size")).alias("pos"))


def pack(pages: DataFrame, per_file: int = 1000) -> DataFrame:
    """file, seq, pos, record for pages in order of page_id, per_file ids a file; a page id stands for at most one record, the first by url and html."""
    rows = page_records(pages)
    place = placed(rows.select("page_id", F.octet_length("record").cast("long").alias("size")), per_file)
    return rows.join(place, "page_id").select("file", "seq", "pos", "record", "page_id")


def op6_fixity_audit(spark, sf_dir: str) -> DataFrame:
    """A replica of all pages' records with known damage is audited: one page in 97 has a changed character, one in 389 is cut short, one in 499 is gone.

    Both replicas' records are digested where the pages are grouped, so the pages' bytes are shuffled once; only digests go on.
    """
    rows = page_records(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    hurt = F.when(F.col("page_id") % 97 == 5, F.concat(F.lit("w"), F.substring("record", 2, 1 << 30))).when(F.col("page_id") % 389 == 7, F.substring("record", 1, 40)).otherwise(F.col("record"))
    both = rows.select("page_id", digested(F.col("record")).alias("good"), digested(hurt).alias("hurt")).withColumn("size", F.col("good.size"))
    both = durable(placed(both).select("page_id", "file", "seq", "pos", "good", "hurt"), "digests")
    good = both.select("file", "seq", "pos", "good.*")
    other = both.where("page_id % 499 <> 11").select("file", "seq", "pos", "hurt.*")
    out = audit_leaves(leaves_of_digests(good), leaves_of_digests(other))
    release(both)
    return out


OP6_SQL = r"""
WITH rec AS (
  SELECT page_id, page_id // 1000 AS n, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
    || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages WHERE page_id IS NOT NULL),
placed AS (
  SELECT page_id, record, 'warc-' || lpad(n::VARCHAR, 8, '0') AS file, row_number() OVER w - 1 AS seq, CAST(sum(strlen(record)) OVER w - strlen(record) AS BIGINT) AS pos
  FROM rec WINDOW w AS (PARTITION BY n ORDER BY page_id)),
other AS (
  SELECT page_id, CASE WHEN page_id % 97 = 5 THEN 'w' || substring(record, 2) WHEN page_id % 389 = 7 THEN substring(record, 1, 40) ELSE record END AS record
  FROM placed WHERE page_id % 499 <> 11),
both_sides AS (
  SELECT p.file, p.seq, p.pos, strlen(p.record) AS sl, strlen(o.record) AS sr, o.record IS NULL AS gone, p.record IS DISTINCT FROM o.record AS bad,
    sha256(p.pos || ':' || strlen(p.record) || ':' || sha256(p.record)) AS hl, sha256(p.pos || ':' || strlen(o.record) || ':' || sha256(o.record)) AS hr
  FROM placed p LEFT JOIN other o ON o.page_id = p.page_id)
SELECT file, seq, pos AS pos_left, sl AS size_left, hl AS hash_left, CASE WHEN NOT gone THEN pos END AS pos_right, sr AS size_right, hr AS hash_right,
  CASE WHEN gone THEN 'missing on the right' ELSE 'changed' END AS state
FROM both_sides WHERE bad
"""
