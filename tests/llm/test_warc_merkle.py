import random

from skein.llm import warc_merkle as wm

SCHEMA = "page_id long, url string, html string, key int, hash string"


def frames(spark, rows, other):
    return tuple(wm.manifest(wm.archive(spark.createDataFrame([(*r, 1, "x") for r in x], SCHEMA))) for x in (rows, other))


def plain(rows, other):
    """Multiset difference of records by key, with offsets from the sorted archive."""
    def record(r):
        body = (r[2] or "").encode()
        return (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{'' if r[0] is None else r[0]}>\r\nWARC-Target-URI: {r[1] or ''}\r\n"
                f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    order = lambda k: (k is not None, k)
    a, b, offset, at = {}, {}, {}, 0
    for r in sorted(rows, key=lambda r: order(r[0]) if r[0] is not None else (False, 0)):
        offset.setdefault(r[0], at)
        at += len(record(r))
    for side, given in ((a, rows), (b, other)):
        for r in given:
            side.setdefault(r[0], []).append(record(r))
    out = {}
    for k in {*a, *b}:
        x, y = list(a.get(k, [])), list(b.get(k, []))
        for r in list(x):
            if r in y:
                x.remove(r), y.remove(r)
        if x or y:
            out[k] = (sum(map(len, x)), sum(map(len, y)), offset.get(k))
    return out


def check(spark, rows, other):
    a, b = frames(spark, rows, other)
    found, summary = wm.audit(a, b)
    got = {}
    for r in found.collect():
        x, y, _ = got.get(r["key"], (0, 0, None))
        times_a = r["copies"] if r["hash_a"] else 0
        got[r["key"]] = (x + (r["size_a"] or 0) * times_a, y + (r["size_b"] or 0) * (r["copies"] if r["hash_b"] else 0), r["offset"])
        assert r["status"] == ("missing" if not r["hash_b"] else "extra" if not r["hash_a"] else "corrupt")
    assert got == plain(rows, other)
    assert (summary["root_a"] == summary["root_b"]) == (not got)
    return summary


def test_single_fault_descends_one_branch(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 5)) for i in range(20_000)]
    other = [(i, u, h + "!") if i == 12_345 else (i, u, h) for i, u, h in rows]
    summary = check(spark, rows, other)
    assert all(n <= 64 for _, n in summary["compared"]) and len(summary["compared"]) == 4


def test_many_faults(spark):
    rnd = random.Random(3)
    rows = [(rnd.randrange(-3000, 10 ** 12) if i % 2 else i, f"u{i}", "é" * rnd.randint(0, 40)) for i in range(900)]
    other = [r if rnd.random() > 0.1 else (r[0], r[1], "changed") for r in rows if rnd.random() > 0.05] + [(10 ** 15, "new", "x")]
    check(spark, rows, other)


def test_odd_rows(spark):
    rows = [(1, "a", None), (1, "a", None), (1, "b", ""), (None, "n", "x"), (None, None, None), (7, "c", "y" * 300_000)]
    check(spark, rows, rows)
    check(spark, rows, list(reversed(rows)))
    check(spark, rows, rows[1:])
    check(spark, rows, rows + [(None, "n", "x")])
    check(spark, rows, [])
    check(spark, [], rows)
    check(spark, [], [])
