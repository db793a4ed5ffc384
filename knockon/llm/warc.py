"""WARC fixity: Merkle trees over records and ordered offset ranges, compared branch by branch.

A leaf is the SHA-256 of one record's bytes.  A node of the first level covers
the records that start in one range of ``RANGE_BYTES`` of a file, a node of each
level above covers ``FAN_OUT`` ranges below it; its hash is over its children in
offset order.  Groups are bounded by the range and the fan-out, so a large file
is as many groups as it has ranges.  The audit compares the replicas' roots and
descends only into branches whose hashes differ.

Defined results: a record found in one replica only is ``missing`` or ``extra``;
one at the same place with other bytes is ``changed``; records repeated at one
place are counted in their leaf; null bytes are hashed as empty; empty replicas
agree; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knockon.llm.common import row_id, shared_table

RANGE_BYTES = 1 << 16
FAN_OUT = 16
RECORDS_PER_FILE = 1000
END = "\r\n\r\n"

LEAF = "record string, file string, offset long, length long, data binary"


def record_text(uri: Column, record: Column, payload: Column) -> Column:
    """A resource record without the two line ends that close it; nulls count as empty."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"),
        F.coalesce(record.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "),
        F.coalesce(uri, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body)


def pack(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
         per_file: int = RECORDS_PER_FILE, stored=None) -> DataFrame:
    """One replica as ``replicas`` lays it out; replicas to be compared come from one call of that."""
    return replicas(pages, [stored], id_col, url_col, html_col, per_file)[0]


def replicas(pages: DataFrame, stored: list, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             per_file: int = RECORDS_PER_FILE) -> list[DataFrame]:
    """Records laid out in files of ``per_file`` pages, in input order: record, file, offset, length, digest.

    One table for each entry of ``stored``, which maps (id, bytes) to the bytes a
    replica holds in place of the record, null if it lost it; None keeps them.
    The layout is written once for all replicas.  Bytes are hashed where they are
    read, in one pass; only hashes and lengths are written and shuffled, and
    offsets are running sums inside one file.
    """
    data = F.concat(record_text(F.col(url_col), F.col(id_col), F.col(html_col)), F.lit(END)).cast("binary")
    rows = pages.select(row_id().alias("row"), F.col(id_col).alias("id"), data.alias("data"))
    held = [F.col("data") if s is None else s(F.col("id"), F.col("data")) for s in stored]
    laid = shared_table(rows.select(
        F.format_string("%05d-%06d.warc", F.shiftright("row", 33),
                        F.floor(F.col("row").bitwiseAND(F.lit((1 << 33) - 1)) / per_file)).alias("file"),
        "row", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("record"),
        F.octet_length("data").cast("long").alias("slot"),
        *[F.struct(F.octet_length(h).cast("long").alias("length"), F.sha2(h, 256).alias("digest")).alias(f"held{i}")
          for i, h in enumerate(held)]), "warc-layout")
    before = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = laid.withColumn("offset", F.coalesce(F.sum("slot").over(before), F.lit(0)))
    return [placed.select("record", "file", "offset", f"held{i}.length", f"held{i}.digest")
            .where(F.col("digest").isNotNull()) for i in range(len(held))]


def write_files(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", per_file: int = RECORDS_PER_FILE) -> None:
    """Write WARC files through Spark's text writer: the record separator is the line separator."""
    (pages.select(record_text(F.col(url_col), F.col(id_col), F.col(html_col)).alias("value"))
     .write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(path))


_LENGTH = re.compile(rb"^content-length:\s*([0-9]+)\s*$", re.I | re.M)
_RECORD_ID = re.compile(rb"^warc-record-id:\s*<?(?:urn:record:)?([^>\r\n]*)>?", re.I | re.M)


def split_records(content: bytes) -> Iterator[tuple[str, int, bytes]]:
    """(record id, offset, bytes) of each record; bytes that are no record end the file as one of their own."""
    at = 0
    while at < len(content):
        head = content.find(b"\r\n\r\n", at)
        length = _LENGTH.search(content, at, head + 2) if head >= 0 else None
        if not content.startswith(b"WARC/", at) or not length:
            yield "", at, content[at:]
            return
        end = min(head + 4 + int(length[1]) + 4, len(content))
        name = _RECORD_ID.search(content, at, head)
        yield name[1].decode("utf-8", "replace") if name else "", at, content[at:end]
        at = end


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of the WARC files in a folder; a task holds one file (2 GB at most) at a time."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"]):
                rows = [(r, name, at, len(data), data) for r, at, data in split_records(bytes(content))]
                yield pd.DataFrame(rows, columns=["record", "file", "offset", "length", "data"])
    files = spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    return files.mapInPandas(split, LEAF)


def leaves(records: DataFrame) -> DataFrame:
    """One row per place: file, offset, record, length, digest; written once, without the bytes."""
    digest = F.col("digest") if "digest" in records.columns else F.sha2(F.coalesce("data", F.lit(b"")), 256)
    places = (records.select("file", "offset", "record", "length", digest.alias("digest"))
              .groupBy("file", "offset", "record", "length", "digest").agg(F.count(F.lit(1)).alias("n")))
    kinds = F.array_sort(F.collect_list(F.struct("digest", "length", "n", "record")))
    return shared_table(
        places.groupBy("file", "offset").agg(kinds.alias("k"))
        .select("file", "offset", F.col("k")[0]["record"].alias("record"), F.col("k")[0]["length"].alias("length"),
                F.when((F.size("k") == 1) & (F.col("k")[0]["n"] == 1), F.col("k")[0]["digest"]).otherwise(
                    F.sha2(F.array_join(F.transform("k", lambda x: F.concat_ws(":", x.digest, x.n.cast("string"))),
                                        ",").cast("binary"), 256)).alias("digest")), "warc-leaves")


def tree(leaf: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> list[DataFrame]:
    """Tables (file, node, digest) from the first level up to the roots."""
    def parents(children: DataFrame, node: Column, place: str) -> DataFrame:
        inside = F.array_sort(F.collect_list(F.struct(F.col(place).alias("at"), "digest")))
        joined = F.array_join(F.transform(inside, lambda x: F.concat_ws(":", x["at"].cast("string"), x.digest)), ",")
        return shared_table(children.groupBy("file", node.cast("long").alias("node")).agg(
            F.sha2(joined.cast("binary"), 256).alias("digest")), "warc-nodes")
    made = [parents(leaf, F.floor(F.col("offset") / range_bytes), "offset")]
    for _ in range(levels - 1):
        made.append(parents(made[-1].withColumnRenamed("node", "child"), F.floor(F.col("child") / fan_out), "child"))
    return made


def _height(replicas: list[DataFrame], range_bytes: int, fan_out: int) -> int:
    """Levels until one node spans the longest file."""
    last = max(t.agg(F.coalesce(F.max("offset"), F.lit(0))).first()[0] for t in replicas) // range_bytes
    levels = 1
    while last > 0:
        last //= fan_out
        levels += 1
    return levels


def _differing(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Keys whose digests differ, or which one side lacks."""
    one, two = a.select(*key, F.col("digest").alias("x")), b.select(*key, F.col("digest").alias("y"))
    return one.join(two, key, "full").where(~F.col("x").eqNullSafe(F.col("y"))).select(*key)


def audit(first: DataFrame, second: DataFrame, range_bytes: int = RANGE_BYTES, fan_out: int = FAN_OUT) -> DataFrame:
    """One row per damaged place: file, offset, record, status, and length and digest in either replica."""
    a, b = leaves(first), leaves(second)
    levels = _height([a, b], range_bytes, fan_out)
    trees = tree(a, levels, range_bytes, fan_out), tree(b, levels, range_bytes, fan_out)
    bad = shared_table(_differing(trees[0][-1], trees[1][-1], ["file", "node"]), "warc-bad")
    for level in range(levels - 2, -1, -1):
        within = [t[level].withColumn("up", F.floor(F.col("node") / fan_out)).join(
            bad.withColumnRenamed("node", "up"), ["file", "up"], "left_semi") for t in trees]
        bad = shared_table(_differing(*within, ["file", "node"]), "warc-bad")
    found = [t.withColumn("node", F.floor(F.col("offset") / range_bytes)).join(bad, ["file", "node"], "left_semi")
             .select("file", "offset", *[F.col(c).alias(f"{c}_{side}") for c in ("record", "length", "digest")])
             for side, t in (("a", a), ("b", b))]
    return (found[0].join(found[1], ["file", "offset"], "full")
            .where(~F.col("digest_a").eqNullSafe(F.col("digest_b")))
            .select("file", "offset", F.coalesce("record_a", "record_b").alias("record"),
                    F.when(F.col("digest_b").isNull(), "missing").when(F.col("digest_a").isNull(), "extra")
                    .otherwise("changed").alias("status"), "length_a", "length_b", "digest_a", "digest_b"))
