"""Merkle fixity audit of WARC archives.

An archive is its records in key order, end to end; a record's range of bytes
is its offset and size. Every record is hashed (SHA-256). Leaves are keys,
a node of level l covers the 64**l keys that share all but their last 6*l bits,
and its hash covers its children's positions, sizes and hashes in order, so it
vouches for an ordered range of offsets. Two replicas are compared from the
root: only the children of nodes that differ are looked at, level by level,
down to the records. Offsets of what is found come from the same descent:
a child begins where its parent does, plus the sizes of its earlier siblings.

All steps are partial aggregations and equality joins; a level has 64 times
fewer rows than the one below, no group has more than 64 children, and records
of one key (however many) are added up in lanes of their hashes, in any order.

Edge cases: null urls and bodies are empty; all records of a null key are one
leaf before all others; repeated keys and repeated rows are a multiset (a lost
or added copy is found); an empty replica differs from any other; two empty
ones agree; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import back_to_id, doc_key, materialize

BITS = 6  # 64 children


def warc_record(key: Column, url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.0 resource record."""
    body = F.encode(F.coalesce(body, F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")),
                    F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def archive(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """key, record: one WARC record for each page."""
    return pages.select(doc_key(id_col).alias("key"), warc_record(F.col(id_col), F.col(url), F.col(body)).alias("record"))


def manifest(records: DataFrame) -> DataFrame:
    """key, size, hash of each record, written once: the records themselves are read a single time."""
    return materialize(records.select("key", F.octet_length("record").cast("long").alias("size"), F.sha2("record", 256).alias("hash")), "manifest")


def _leaves(fixity: DataFrame) -> DataFrame:
    lanes = [F.sum(F.conv(F.substring("hash", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"l{i}") for i in range(4)]
    summed = fixity.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), *lanes)
    return summed.select(F.col("key").alias("node"), "n", "bytes",
                         F.sha2(F.concat_ws(":", "n", "bytes", *[f"l{i}" for i in range(4)]), 256).alias("hash"))


def tree(fixity: DataFrame) -> list[DataFrame]:
    """Levels from the leaves to at most two nodes: node, n, bytes, hash."""
    levels = [materialize(_leaves(fixity), "merkle")]
    while True:
        span = levels[-1].agg(F.min("node"), F.max("node")).first()
        if span[0] is None or span[1] - span[0] <= 1:
            return levels
        levels.append(_up(levels[-1]))


def _up(level: DataFrame) -> DataFrame:
    below = level.select(F.shiftright("node", BITS).alias("up"), "node", "n", "bytes", "hash")
    children = F.array_sort(F.collect_list(F.struct("node", "bytes", "hash")))  # 64 at most
    up = below.groupBy("up").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), children.alias("c"))
    listed = F.transform("c", lambda c: F.concat_ws(":", c["node"], c["bytes"], c["hash"]))
    return materialize(up.select(F.col("up").alias("node"), "n", "bytes", F.sha2(F.array_join(listed, ","), 256).alias("hash")), "merkle")


def root(levels: list[DataFrame]) -> str:
    """The hash over the top level (at most two nodes)."""
    import hashlib

    top = sorted(tuple(r) for r in levels[-1].select("node", "bytes", "hash").collect())
    return hashlib.sha256(repr((len(levels), top)).encode()).hexdigest()


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes (with their offset in a) that are not the same in both."""
    x = a.select("node", "offset", F.col("hash").alias("ha"))
    y = b.select("node", F.col("hash").alias("hb"))
    return x.join(y, "node", "full_outer").where(~F.col("ha").eqNullSafe(F.col("hb"))).select("node", "offset")


def audit(a: DataFrame, b: DataFrame) -> tuple[DataFrame, dict]:
    """Compares two manifests. Rows: key, status (corrupt, missing or extra in
    b), offset (of the key's first record in a), hash_a, size_a, hash_b,
    size_b, copies (how many more of the record one side has). And a summary:
    the roots and how many nodes were compared on each level."""
    spark = a.sparkSession
    ta, tb = tree(a), tree(b)
    # both get as many levels, so that they meet at the top
    for t, other in ((ta, tb), (tb, ta)):
        while len(t) < len(other):
            t.append(_up(t[-1]))
    summary = {"root_a": root(ta), "root_b": root(tb), "compared": []}
    if summary["root_a"] == summary["root_b"]:
        return _rows(a.limit(0), b.limit(0), spark.createDataFrame([], "node long, offset long")), summary
    wrong = None
    for level in range(len(ta) - 1, -1, -1):
        here_a, here_b = ta[level], tb[level]
        if wrong is None:  # at most two nodes
            before = Window.orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            here_a = here_a.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))
        else:
            parent = F.shiftright("node", BITS)
            known = wrong.select(F.col("node").alias("_up"), F.col("offset").alias("_from"))
            earlier = Window.partitionBy("_up").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
            here_a = (here_a.withColumn("_up", parent).join(known, "_up")
                      .withColumn("offset", F.col("_from") + F.coalesce(F.sum("bytes").over(earlier), F.lit(0))))
            here_b = here_b.withColumn("_up", parent).join(known.select("_up"), "_up", "left_semi")
        summary["compared"].append((level, here_a.count()))
        wrong = materialize(_differing(here_a, here_b), "merkle_wrong")
    return _rows(a, b, wrong), summary


def _rows(a: DataFrame, b: DataFrame, wrong: DataFrame) -> DataFrame:
    """The records behind differing leaves."""
    def side(x, s):
        return (x.join(wrong.select(F.col("node").alias("key")), "key", "left_semi")
                .groupBy("key", "hash", "size").agg(F.count(F.lit(1)).alias(f"n_{s}")))
    both = side(a, "a").join(side(b, "b"), ["key", "hash", "size"], "full_outer")
    more = F.coalesce("n_a", F.lit(0)) - F.coalesce("n_b", F.lit(0))
    left = both.withColumn("more", more).where("more <> 0")
    # of one key, the records that only a has and those that only b has are paired in hash order
    k = Window.partitionBy("key", F.col("more") > 0).orderBy("hash")
    named = left.withColumn("k", F.row_number().over(k))
    lost = named.where("more > 0").select("key", "k", F.col("hash").alias("hash_a"), F.col("size").alias("size_a"), F.col("more").alias("ca"))
    new = named.where("more < 0").select("key", "k", F.col("hash").alias("hash_b"), F.col("size").alias("size_b"), (-F.col("more")).alias("cb"))
    status = F.when(F.col("hash_b").isNull(), "missing").when(F.col("hash_a").isNull(), "extra").otherwise("corrupt")
    return (lost.join(new, ["key", "k"], "full_outer")
            .join(wrong.select(F.col("node").alias("key"), "offset"), "key")
            .select(back_to_id("key").alias("key"), status.alias("status"), "offset", "hash_a", "size_a", "hash_b", "size_b",
                    F.greatest("ca", "cb").alias("copies")))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of the pages table with faults by page_id: changed letters, cut
    bodies, lost records and added ones (data for audits)."""
    i = F.col("page_id")
    html = (F.when(i % 97 == 13, F.concat(F.lit("~"), F.expr("substr(html, 2)")))
            .when(i % 89 == 5, F.expr("substr(html, 1, length(html) div 2)")).otherwise(F.col("html")))
    kept = pages.where(~(F.coalesce(i, F.lit(0)) % 101 == 7)).select("page_id", "url", html.alias("html"))
    return kept.unionByName(pages.where(i % 211 == 17).select("page_id", F.concat("url", F.lit("#copy")).alias("url"), "html"))
