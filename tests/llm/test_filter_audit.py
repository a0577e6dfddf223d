import re
from itertools import permutations

import pytest

from skein.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(text, i, rows):
    text = text or ""
    ws = WORD.findall(text)
    return {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)), "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)}


def plain(rows, labels):
    """Each order applied filter by filter, document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, fails(t, i, rows)) for i, t, s in rows if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(d[1][f] for d in docs) - len(gone),
                    sum(d[1][f] and sum(d[1].values()) == 1 for d in docs), sum(d[0] in good for d in gone), sum(d[0] in toxic for d in gone)]
        for key, v in out.items():
            if key[0] == part:
                v.append(shapley[key[1][key[2] - 1]])
    return out


LONG = " ".join(f"word{i}" for i in range(250))
ROWS = [
    (1, None, "a"), (2, "", "a"), (3, "few words", None), (4, "few words", ""), (5, LONG, "a"), (6, LONG, "b"), (7, LONG, "b"),
    (7, LONG, "b"), (8, LONG + " #", "b"), (9, LONG.upper(), "a"), (10, "same " * 400, "a"), (11, "same " * 400, "b"),
    (12, "SAME & " * 40000, "b"), (13, "\x0b" + LONG + "\x0c \r\n", "a"), (14, "é😀 " * 150 + "A" * 9, "a"), (None, LONG, "a"),
    (None, "few words", "b"), (5, LONG, "b"), (15, "Aa aA AA aa " * 60, "c"), (4, LONG, "a"), (20, "x\x00y$", "c"), (21, "x y z\xa0w", "c")]
LABELS = [(1, 1, 0), (2, 0, 1), (5, 1, 1), (6, None, None), (7, 1, 0), (7, 0, 1), (10, 1, 1), (11, 1, 0), (12, 0, 1), (None, 1, 1), (99, 1, 1), (4, 1, 0)]


def run(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, "x", 3) for i, t, s in rows], "doc_id long, text string, source string, part string, mask int")
    known = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, n string")
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
            for r in filter_audit.audit_filters(docs, known).collect()}


def test_equals_every_order_applied(spark):
    got, want = run(spark, ROWS, LABELS), plain(ROWS, LABELS)
    assert set(got) == set(want) and len(got) == 600 * 4
    assert got == want


def test_no_labels_and_empty_table(spark):
    assert run(spark, [], LABELS) == {}
    got = run(spark, ROWS[:4], [])
    assert got == plain(ROWS[:4], [])


@pytest.mark.parametrize("copies", [60])
def test_one_text_in_most_rows(spark, copies):
    rows = [(i, LONG, f"s{i % 3}") for i in range(copies, 0, -1)] + [(i + 100, LONG + f" {i}", "s0") for i in range(9)]
    labels = [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(1, 110)]
    assert run(spark, rows, labels) == plain(rows, labels)


def test_plan_has_no_cross_join(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    known = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    plan = filter_audit.audit_filters(docs, known)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
