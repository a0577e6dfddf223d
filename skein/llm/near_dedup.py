"""Near-duplicates by chosen-path set similarity join.

Documents are word-shingle sets. Equal sets are one class from the start.
``TREES`` trees branch the classes: at a node two minwise
positions are chosen (by a hash of the node's path), and a class goes to the
child of its minwise token at each of them. Nodes of at most ``LEAF`` classes
are compared exhaustively on sketches; larger ones branch again; those still
large after ``DEPTH`` more levels (near copies that agree everywhere) are cut into
blocks and all pairs of blocks are compared, so nothing is dropped. Two sets
of similarity 0.85 share one of two tokens with probability 0.978, and
survive to any depth of a tree with 0.969 or more: five trees miss one such
pair in about 10**7.

Sketches only shortlist: one-permutation minwise bytes in 512 bins, with a
margin of over four standard deviations. Classes that the shortlist connects
form clusters; a cluster's whole sets meet once (in blocks if they are large)
and the links are confirmed on them. Inside a task links are followed breadth
first, and only one edge for each newly reached class leaves it, so a group of
thousands of copies sends thousands of rows, not their pairs.

Edge cases: null or empty texts (no words) have no shingles and link with
nothing; repeated rows (equal id and set) give one row; rows of one id with
different sets give a row each; a null id ranks last, so it represents a
component only if all its ids are null; an empty table gives an empty result;
further input columns are ignored (``keep_first`` keeps them, and one row of each
component, whatever its ids).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm import shingles
from skein.llm.batches import small_batches
from skein.llm.common import binary_parts, components, materialize, only_keys, partitions, split_by_keys, whole_groups

TREES, BRANCHES = 5, 2
LEAF = 2048
DEPTH = 4
DEEPER = 16  # minwise positions for the levels below the first
POSITIONS = TREES * BRANCHES + DEEPER
BINS = 512
MARGIN = 0.07
CLUSTER_ITEMS, CLUSTER_SETS = 2_000_000, 4096  # of one task's share of a cluster
LAST = 2 ** 63 - 1  # stands for a null id

_FLIP = shingles._series(9000, POSITIONS)
_TIMES = shingles._series(9500, POSITIONS) | np.uint64(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """The smallest hash of the set under each of ``POSITIONS`` hash functions."""
    low = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 4096):
        low = np.minimum(low, ((s[k:k + 4096, None] ^ _FLIP) * _TIMES).min(axis=0))
    return low


def sketch(s: np.ndarray) -> np.ndarray:
    """A byte for each of ``BINS`` ranges of the hash: of its smallest member, 0 if there is none."""
    out = np.zeros(BINS, np.uint8)
    bins = (s >> np.uint64(55)).astype(np.int64)
    first = np.append(True, bins[1:] != bins[:-1])
    out[bins[first]] = (1 + (s[first] >> np.uint64(5)) % np.uint64(255)).astype(np.uint8)
    return out


def similar_sketches(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of one sketch with each row of many."""
    same = ((many == one) & (one != 0)).sum(axis=1)
    either = ((many != 0) | (one != 0)).sum(axis=1)
    return same / np.maximum(either, 1)


def set_hash(s: np.ndarray) -> int:
    return int(shingles.mix(np.array([shingles.mix(s).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _sketches(docs: DataFrame, id_col: str, by_text: bool = False) -> DataFrame:
    """_id, (with ``by_text``) _th, n, sid (of the set; 0 shingles: null), mins, sketch of each document."""
    keys = ["_id", "_th"] if by_text else ["_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sid, mins, bins = [], [], [], []
            for s in shingles.sets(batch.column("text").to_pylist()):
                n.append(len(s))
                if not len(s):
                    sid.append(None), mins.append(None), bins.append(None)
                    continue
                sid.append(set_hash(s))
                mins.append(minwise(s).view(np.int64))
                bins.append(sketch(s).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], pa.array(n, pa.int64()), pa.array(sid, pa.int64()),
                 pa.array(mins, pa.list_(pa.int64())), pa.array(bins, pa.binary())], [*keys, "n", "sid", "mins", "sketch"])

    own = {"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)), "_th": _text_hash()}
    return (docs.select(*[own[k].alias(k) for k in keys], "text")
            .mapInArrow(run, ", ".join(f"{k} long" for k in keys) + ", n long, sid long, mins array<long>, sketch binary"))


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def _reach(n: int, near) -> Iterator[tuple[int, int]]:
    """(first member, other member) of each connected group of two or more,
    searched breadth first; ``near(i, rest)`` gives the members of ``rest`` linked with i."""
    left = np.arange(n)
    while len(left):
        root, left = int(left[0]), left[1:]
        queue = [root]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if len(hit):
                for j in hit.tolist():
                    yield root, j
                queue.extend(hit.tolist())
                left = np.setdiff1d(left, hit, assume_unique=True)


def _shortlist(rows: DataFrame, keys: list[str], least: float) -> DataFrame:
    """u, v: spanning edges of the sketch similarity graph of each group of rows (keys, sid, sketch)."""
    n = partitions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, keys):
            sid = table.column("sid").combine_chunks().to_numpy(zero_copy_only=False)
            bins = binary_parts(table.column("sketch"))[0].reshape(-1, BINS)
            us, vs = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = bins[a:b]
                for i, j in _reach(b - a, lambda i, rest: rest[similar_sketches(own[i], own[rest]) >= least]):
                    us.append(sid[a + i]), vs.append(sid[a + j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return (rows.select(*keys, "sid", "sketch").repartition(n, *keys).sortWithinPartitions(*keys, "sid")
            .mapInArrow(run, "u long, v long"))


def candidate_edges(sets: DataFrame, similarity: float, leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """Shortlisted links between classes: u, v. ``sets`` has a row (sid, mins, sketch) for each class."""
    least = similarity - MARGIN
    # two levels at once: nodes of a single token mostly gather strangers that share a common phrase
    top = sets.select("sid", "mins", F.posexplode(F.slice("mins", 1, TREES * BRANCHES)).alias("i", "m"))
    members = _children(top.select(F.xxhash64("i", "m").alias("node"), "sid", "mins"))
    found = None
    for level in range(depth + 1):
        sizes = members.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = materialize(members.join(sizes, "node"), "path_sizes")
        small = sized.where(F.col("size") <= leaf).select("node", F.lit(0).cast("long").alias("part"), "sid")
        large = sized.where(F.col("size") > leaf)
        if level == depth:
            # blocks of at most about leaf / 2 classes, each pair of blocks one group
            cut = large.select("node", "sid", F.ceil(2 * F.col("size") / leaf).alias("k"))
            cut = cut.withColumn("b", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("k")))
            small = small.unionByName(cut.select("node", F.explode(F.transform(
                F.sequence(F.lit(0).cast("long"), F.col("k") - 1),
                lambda o: F.least("b", o) * F.col("k") + F.greatest("b", o))).alias("part"), "sid"))
        edges = _shortlist(small.join(sets.select("sid", "sketch"), "sid"), ["node", "part"], least)
        edges = materialize(edges, "shortlist")
        found = edges if found is None else found.unionByName(edges)
        if level == depth or not large.take(1):
            break
        members = materialize(_children(large.select("node", "sid").join(sets.select("sid", "mins"), "sid")), "paths")
    return found


def _children(members: DataFrame) -> DataFrame:
    """node, sid one level down: two positions chosen by a hash of the node's path."""
    pick = [F.pmod(F.xxhash64("node", F.lit(r)), F.lit(DEEPER)).cast("int") for r in range(BRANCHES)]
    second = F.when(pick[0] == pick[1], (pick[1] + 1) % DEEPER).otherwise(pick[1])
    return members.select(F.explode(F.array(*[
        F.xxhash64("node", p, F.get("mins", p + TREES * BRANCHES)) for p in (pick[0], second)])).alias("node"), "sid")


def _confirm(rows: DataFrame, num: int, den: int, margin: float) -> DataFrame:
    """u, v: spanning links, on whole sets, of each group of rows (cluster, part, sid, items)."""
    n = partitions(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["cluster", "part"]):
            sid = table.column("sid").combine_chunks().to_numpy(zero_copy_only=False)
            raw, at = binary_parts(table.column("items"))
            items, at = raw.view(np.uint64) if not raw.ctypes.data % 8 else raw.copy().view(np.uint64), at // 8
            us, vs = [], []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = [items[at[r]:at[r + 1]] for r in range(a, b)]
                size = np.array([len(s) for s in own])
                bins = np.stack([sketch(s) for s in own])

                def near(i, rest):
                    rest = rest[similar_sketches(bins[i], bins[rest]) >= num / den - margin]
                    if not len(rest):
                        return rest
                    mine, other = own[i], np.concatenate([own[j] for j in rest])
                    where = np.minimum(np.searchsorted(mine, other), len(mine) - 1)
                    ends = np.cumsum(size[rest])
                    common = np.add.reduceat((mine[where] == other).astype(np.int64), np.append(0, ends[:-1]))
                    return rest[den * common >= num * (size[rest] + len(mine) - common)]

                for i, j in _reach(b - a, near):
                    us.append(sid[a + i]), vs.append(sid[a + j])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return (rows.select("cluster", "part", "sid", "items").repartition(n, "cluster", "part")
            .sortWithinPartitions("cluster", "part", "sid").mapInArrow(run, "u long, v long"))


def _with_items(docs: DataFrame, id_col: str, wanted: DataFrame) -> DataFrame:
    """cluster, sid, n, items (sorted 64-bit hashes) of the classes ``wanted`` (rep, cluster, sid, n, k)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = list(shingles.sets(batch.column("text").to_pylist()))
            right = [len(s) > 0 and set_hash(s) == sid for s, sid in zip(own, batch.column("sid").to_pylist())]
            kept = batch.filter(pa.array(right))
            items = [s.astype("<u8").tobytes() for s, ok in zip(own, right) if ok]
            yield pa.RecordBatch.from_arrays([kept.column("cluster"), kept.column("sid"), kept.column("k"), pa.array(items, pa.binary())],
                                             ["cluster", "sid", "k", "items"])

    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("rep"), "text")
    # only texts that have candidates are hashed again; of an id with several sets, the one with the class's hash
    wanted = wanted.select("rep", "cluster", "sid", "k").hint("merge")  # the same plan at every size
    joined = only_keys(keyed, wanted, ["rep"]).join(wanted, "rep").select("cluster", "sid", "k", "text")
    return joined.mapInArrow(run, "cluster long, sid long, k long, items binary")


def _classes(docs: DataFrame, similarity: tuple[int, int], id_col: str, leaf: int, depth: int,
             by_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of ``_sketches``; and sid, component (the smallest id reachable) and,
    with ``by_text``, first_th (of that id's texts in the component, the smallest hash)."""
    num, den = similarity
    every = materialize(_sketches(small_batches(docs), id_col, by_text), "sketches")
    rep_th = [F.min_by("_th", F.struct("_id", "_th")).alias("rep_th")] if by_text else []
    sets = materialize(every.where("sid is not null").groupBy("sid").agg(
        F.min("_id").alias("rep"), *rep_th, F.first("n").alias("n"), F.first("mins").alias("mins"), F.first("sketch").alias("sketch")), "sets")
    edges = candidate_edges(sets.select("sid", "mins", "sketch"), num / den, leaf, depth)
    clusters = components(edges).select(F.col("node").alias("sid"), F.col("root").alias("cluster"))
    members = materialize(sets.select("sid", "rep", "n").join(clusters, "sid"), "clusters")
    shares = members.groupBy("cluster").agg(F.greatest(
        F.ceil(F.sum("n") / CLUSTER_ITEMS), F.ceil(F.count(F.lit(1)) / CLUSTER_SETS)).alias("k"))
    items = _with_items(docs, id_col, materialize(members.join(shares, "cluster"), "wanted"))
    part = F.pmod(F.xxhash64("sid", F.lit(11)), F.col("k"))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("k") - 1),
                        lambda o: F.least(part, o) * F.col("k") + F.greatest(part, o))
    rows = items.select("cluster", F.explode(parts).alias("part"), "sid", "items")
    links = materialize(_confirm(rows, num, den, MARGIN), "links")
    classes = components(links).select(F.col("node").alias("sid"), "root")
    th = ["rep_th"] if by_text else []
    first_th = [F.min_by("rep_th", F.struct("rep", "rep_th")).alias("first_th")] if by_text else []
    named = sets.select("sid", "rep", *th).join(classes, "sid")
    first = named.groupBy("root").agg(F.min("rep").alias("component"), *first_th)
    by_set = (sets.select("sid", "rep", *th).join(classes, "sid", "left").join(first, "root", "left")
              .select("sid", F.coalesce("component", "rep").alias("component"),
                      *[F.coalesce("first_th", "rep_th").alias("first_th") for _ in th]))
    return every, by_set


def link(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id",
         leaf: int = LEAF, depth: int = DEPTH) -> DataFrame:
    """_id, n, component: for each distinct (id, set), the set's size and the smallest id reachable."""
    every, by_set = _classes(docs, similarity, id_col, leaf, depth)
    return (every.select("_id", "n", "sid").distinct().join(by_set, "sid", "left")
            .select("_id", "n", "sid", F.coalesce("component", "_id").alias("component")))


def near_duplicates(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return link(docs, similarity, id_col).select(
        back("_id").alias("doc_id"), F.col("n").alias("n_shingles"), back("component").alias("component_id"),
        (F.col("_id") == F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, similarity: tuple[int, int] = (85, 100), id_col: str = "doc_id") -> DataFrame:
    """``docs`` (all columns) with one row of each component: of its smallest id,
    the smallest text hash, and one of the rows equal in both. Rows without
    words are in no component and all stay."""
    every, by_set = _classes(docs, similarity, id_col, LEAF, DEPTH, by_text=True)
    texts = (every.where("sid is not null").groupBy("_id", "_th")
             .agg(F.first("sid").alias("sid"), F.count(F.lit(1)).alias("copies")))
    first = (F.col("_id") == F.col("component")) & (F.col("_th") == F.col("first_th"))
    marked = materialize(texts.join(by_set, "sid").where(~first | (F.col("copies") > 1))
                         .select(F.col("_id").alias("_drop_id"), F.col("_th").alias("_drop_th"), first.alias("_first")), "near_copies")
    on = ["_drop_id", "_drop_th"]
    keyed = docs.withColumn("_drop_id", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST))).withColumn("_drop_th", _text_hash())
    maybe, kept = split_by_keys(keyed, marked, on)
    out = kept.unionByName(maybe.join(marked, on, "left_anti"))
    repeated = marked.where("_first").select(*on)
    if repeated.take(1):
        out = out.unionByName(only_keys(keyed, repeated, on).join(repeated, on, "left_semi").dropDuplicates(on))
    return out.select(*docs.columns)
