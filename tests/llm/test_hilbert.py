import itertools
import zlib

from pyspark.sql import functions as F

from skein.llm import hilbert


def walk(dims, bits):
    digit, following = hilbert.curve_tables(dims)
    out = {}
    for cell in itertools.product(range(1 << bits), repeat=dims):
        s = h = 0
        for b in range(bits - 1, -1, -1):
            code = sum(((c >> b) & 1) << j for j, c in enumerate(cell))
            s, h = following[(s << dims) + code], (h << dims) + digit[(s << dims) + code]
        out[h] = cell
    return out


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = walk(dims, bits)
        assert sorted(cells) == list(range(1 << dims * bits))
        for h in range(len(cells) - 1):
            assert sum(abs(a - b) for a, b in zip(cells[h], cells[h + 1])) == 1


def test_native_index_is_the_same_curve(spark):
    grid = spark.range(8).select(F.col("id").cast("int").alias("x")).crossJoin(
        spark.range(8).select(F.col("id").cast("int").alias("y")))
    got = grid.select("x", "y", hilbert.hilbert_index([F.col("x"), F.col("y")], 3).alias("h")).collect()
    assert {r["h"]: (r["x"], r["y"]) for r in got} == walk(2, 3)


SCHEMA = "doc_id long, text string, source string, lang string, size long, rank long"


def check(rows, spark):
    df = spark.createDataFrame(rows, SCHEMA)
    got = hilbert.shard_documents(df).collect()
    assert len(got) == len(rows)
    by_doc = sorted((r["doc_id"] is not None, r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    want = sorted((i is not None, i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert by_doc == want
    shards = {s: sorted(r["slot"] for r in got if r["shard"] == s) for s in range(16)}
    assert all(slots == list(range(len(slots))) for slots in shards.values())
    counts = [len(x) for x in shards.values()]
    assert max(counts) - min(counts) <= 1
    assert {r["law"] for r in got} <= {"rows"} and {r["shard"] for r in got} <= set(range(16))
    order = sorted(got, key=lambda r: (r["shard"], r["slot"]))
    assert [r["curve"] for r in order] == sorted(r["curve"] for r in got)


def test_shards(spark, words):
    rows = [(i, " ".join(words[i % 7: i % 7 + i % 50]), f"src{i % 5 if i % 3 else 0}", ["en", "de", None][i % 3], 0, 1) for i in range(501)]
    check(rows + [(700 + i, "same text", "src0", "en", 0, 1) for i in range(170)], spark)


def test_odd_rows(spark):
    check([(1, None, None, None, 5, 5), (1, "", None, None, 5, 5), (1, "", None, None, 5, 5), (None, "é😀", "a", "b", 0, 0),
           (2, "x" * 200000, "", "", None, None)], spark)
    check([], spark)


def test_sources_with_a_common_start_are_told_apart(spark):
    """Values are cells by rank and row counts, however alike they begin; a hot one holds its share of the cells."""
    names = [f"https://example.org/{c}" for c in "dacb"] + [None, ""]
    rows = [(i, names[i % 6] if i % 3 else names[0]) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = {r["source"]: r["cell"] for r in hilbert.with_value_cell(df, "source", "cell", 6).select("source", "cell").distinct().collect()}
    order = sorted(set(names), key=lambda s: (s is not None, s or ""))
    before = {s: sum((x is not None, x or "") < (s is not None, s or "") for _, x in rows) for s in order}
    assert got == {s: before[s] * 64 // 600 for s in {x for _, x in rows}}
    assert len(set(got.values())) == len(got)
    docs = df.selectExpr("doc_id", "'same text' as text", "source", "'en' as lang")
    placed = hilbert.shard_documents(docs, 4).join(df, "doc_id").groupBy("shard").agg(F.countDistinct("source").alias("n")).collect()
    assert sum(r["n"] for r in placed) <= len(got) + 3  # each shard holds a run of sources
