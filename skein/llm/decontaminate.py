"""Benchmark decontamination with SimHash windows and a multi-index.

A document is contaminated by a benchmark item if some window of the item's
length (in words) has a weighted-shingle similarity of 0.8 or more with it:
shared five-word shingles, counted as often as they occur, over all of either.

1. Shingles are first matched with the items'. A window whose matches, wherever
   the items have them, are too few for the similarity even if all counted
   cannot be similar; every other window of the text is proposed.
2. Proposed windows get a 64-bit SimHash of their shingles.
3. The items' SimHashes are indexed by eight blocks of eight bits. Two
   fingerprints within ``RADIUS`` bits differ in at most RADIUS / 8 bits of
   one block, so the index holds every block value within that distance, and
   an equality join finds all fingerprints within the radius. At similarity
   0.8 the distance is 9.7 bits on average with a standard deviation of 2.9;
   the radius is over four deviations away.
4. The exact similarity of each candidate decides.

Only DataFrame functions run. The item tables are broadcast while they are
under a checked bound and joined by shuffles (behind a bitmap filter of fixed
size) beyond it. Documents without a match never cross the network.

Edge cases: null or empty texts and items have no shingles and match nothing;
a text or item of one to four words is one shingle as a whole, so such an item
matches only a text that is just it; windows are cut at the text's ends;
repeated rows (equal id and text) are one document, rows of one id with
different texts add up; null ids are kept; an empty table gives an empty
result; further input columns are ignored (``keep_clean`` keeps them).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import NO_ID, back_to_id, doc_key, materialize, only_keys, split_by_keys

WORDS = 5
SIMILARITY = 0.8
BLOCKS, BLOCK_BITS = 8, 8
RADIUS = 22
BROADCAST_ROWS = 500_000  # of (hash, length), or hashes of bags
#: every way to change at most RADIUS / BLOCKS bits of a block
MASKS = [sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(BLOCK_BITS), k)]


def word_list(text: Column) -> Column:
    """Runs of anything but space and the characters 9 to 13, A-Z lower-cased."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[ \t\n\x0b\f\r]+"), "")


def let(value: Column, then) -> Column:
    """``then(value)`` with the value bound to a variable, so that it is made once
    for a row: an expression that a lambda's body names could be put into it
    and made again for each element."""
    return F.get(F.transform(F.array(value), then), 0)


def with_shingles(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words and hs (the shingles' hashes by position) instead of its text."""

    def hashed(ws: Column) -> Column:
        n = F.size(ws)
        hs = (F.when(n >= WORDS, F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(F.slice(ws, i, WORDS))))
              .when(n > 0, F.array(F.xxhash64(ws)))
              .otherwise(F.array().cast("array<long>")))
        return F.struct(n.alias("n"), hs.alias("hs"))

    return (df.withColumn("_s", let(word_list(F.col(text)), hashed))
            .withColumns({"n_words": F.col("_s.n"), "hs": F.col("_s.hs")}).drop("_s", text))


def simhash(hs: str) -> Column:
    """Bit b is set when more than half of the hashes have it."""
    return F.expr(f"""aggregate(transform(sequence(0, 63), b -> if(
        2 * aggregate({hs}, 0, (a, h) -> a + cast(shiftright(h, b) & 1L as int)) > size({hs}), shiftleft(1L, b), 0L)),
        0L, (a, x) -> a | x)""")


def bag(hs: str) -> Column:
    """A bag of hashes as a set: each with the number of equal ones before it."""
    return let(F.array_sort(hs), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x))))


def blocks(fingerprint: str) -> Column:
    return F.expr(f"transform(sequence(0, {BLOCKS - 1}), i -> struct(i as i, shiftright({fingerprint}, {BLOCK_BITS} * i) & {(1 << BLOCK_BITS) - 1}L as v))")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def starts(similarity: float) -> Column:
    """The starts of all windows of ``len`` words with enough of the matched positions
    ``ps`` (ascending) for the similarity: c common shingles of a window of w and
    an item of m give c / (w + m - c). Each start is listed at the first match
    that its window has."""
    size = F.greatest(F.col("len") - (WORDS - 1), F.lit(1))
    own = F.least(size, F.greatest(F.col("n_words") - (WORDS - 1), F.lit(1)))
    need = F.greatest(F.lit(1), F.ceil((size + own) * (similarity / (1 + similarity)) - 1e-6).cast("int"))
    last = F.greatest(F.lit(0), F.col("n_words") - F.col("len"))

    def at(n: Column) -> Column:
        def of(i: Column) -> Column:
            low = F.greatest(F.when(i > 0, F.get("ps", i - 1) + 1).otherwise(0), F.get("ps", i + n - 1) - size + 1)
            high = F.least(F.get("ps", i), last)
            return F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))

        return F.when(F.size("ps") >= n, F.flatten(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ps") - n)), of)))

    return let(need, at)


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """_id, _th, item_id, similarity, distance, start, n_words: the best window of each contaminated pair."""
    items = materialize(with_shingles(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"))
                        .where("n_words > 0").distinct()
                        .withColumn("_item", F.xxhash64(F.coalesce("item_id", F.lit(NO_ID)), "hs"))
                        .withColumn("fp", simhash("hs")).withColumn("bag", bag("hs")), "items")
    places = materialize(items.select(F.col("n_words").alias("len"), F.explode("hs").alias("h"))
                         .select("h", "len").distinct(), "item_shingles")
    n_places = places.count()
    n_items, n_bags = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("bag")), F.lit(0))).first()

    keyed = docs.select(doc_key().alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"), "text")
    at = with_shingles(keyed).select("_id", "_th", "n_words", F.posexplode("hs").alias("p", "h"))
    hits = (at if n_places <= BROADCAST_ROWS else only_keys(at, places, ["h"])).join(_small(places, n_places), "h")
    matched = (hits.groupBy("_id", "_th", "n_words", "len").agg(F.array_sort(F.collect_set("p")).alias("ps"))
               .select("_id", "_th", "len", F.explode(starts(similarity)).alias("start")))
    proposed = materialize(matched.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "len")).alias("ws")), "windows")
    again = with_shingles(only_keys(keyed, proposed, ["_id", "_th"]).dropDuplicates(["_id", "_th"]))
    windows = (again.join(proposed, ["_id", "_th"]).select("_id", "_th", "hs", F.explode("ws").alias("w"))
               .select("_id", "_th", "w.start", "w.len",
                       F.slice("hs", F.col("w.start") + 1, F.greatest(F.col("w.len") - (WORDS - 1), F.lit(1))).alias("hs"))
               .where(F.size("hs") > 0))
    windows = materialize(windows.withColumn("fp", simhash("hs")).withColumn("bag", bag("hs")).drop("hs"), "fingerprints")

    index = (items.select("_item", F.col("n_words").alias("len"), F.explode(blocks("fp")).alias("b"))
             .select("_item", "len", "b.i", F.explode(F.transform(F.array(*[F.lit(m) for m in MASKS]),
                                                                  lambda m: F.col("b.v").bitwiseXOR(m.cast("long")))).alias("v")))
    probes = windows.select("_id", "_th", "start", "len", F.explode(blocks("fp")).alias("b")).select("_id", "_th", "start", "len", "b.i", "b.v")
    candidates = (probes.join(_small(index, n_items * BLOCKS * len(MASKS)), ["len", "i", "v"])
                  .select("_id", "_th", "start", "len", "_item").distinct())
    sides = items.select("_item", "item_id", F.col("fp").alias("item_fp"), F.col("bag").alias("item_bag"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    common = F.size(F.array_intersect("bag", "item_bag"))
    checked = (candidates.join(windows, ["_id", "_th", "start", "len"]).join(_small(sides, n_bags), "_item")
               .withColumn("distance", distance).where(F.col("distance") <= RADIUS)
               .withColumn("similarity", common / (F.size("bag") + F.size("item_bag") - common))
               .where(F.col("similarity") >= similarity))
    best = F.max(F.struct("similarity", -F.col("distance"), -F.col("start"), "len")).alias("b")
    return (checked.select("_id", "_th", "item_id", "similarity", "distance", "start", "len")
            .groupBy("_id", "_th", "item_id").agg(best)
            .select("_id", "_th", "item_id", "b.similarity", (-F.col("b.col2")).alias("distance"),
                    (-F.col("b.col3")).alias("start"), F.col("b.len").alias("n_words")))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, similarity, distance, start (word), n_words: one row for
    each document and benchmark item that it leaks, with the best window."""
    order = Window.partitionBy("_id", "item_id").orderBy(F.col("similarity").desc(), "distance", "_th")
    return (leaks(docs, benchmark, similarity).withColumn("_k", F.row_number().over(order)).where("_k = 1")
            .select(back_to_id("_id").alias("doc_id"), "item_id", "similarity", F.col("distance").cast("long").alias("distance"),
                    F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` (all columns) without the rows whose text leaks an item."""
    found = materialize(leaks(docs, benchmark, similarity).select(
        F.col("_id").alias("_leak_id"), F.col("_th").alias("_leak_th")).distinct(), "leaks")
    keyed = docs.withColumn("_leak_id", doc_key()).withColumn("_leak_th", F.xxhash64(F.coalesce("text", F.lit(""))))
    maybe, clean = split_by_keys(keyed, found, ["_leak_id", "_leak_th"])
    return clean.unionByName(maybe.join(found, ["_leak_id", "_leak_th"], "left_anti")).select(*docs.columns)
