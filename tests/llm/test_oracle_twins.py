"""The SQL twins state the operators' rules, also where the given tables have no such case."""

import duckdb
import pyarrow as pa

from skein.llm import decontaminate, secrets
from skein.llm.oracle import ORACLE


def duck(sql, **tables):
    con = duckdb.connect()
    for name, rows in tables.items():
        con.register(name, pa.Table.from_pylist(rows))
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted(tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in out.fetchall())


def same(df, sql, **tables):
    cols = sorted(df.columns)
    got = sorted(tuple(round(r[c], 9) if isinstance(r[c], float) else r[c] for c in cols) for r in df.collect())
    want = [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in duck(sql, **tables)]
    assert got == want
    return got


def test_best_window_far_from_every_alignment(spark):
    """Words changed at both ends and inserted in the middle: the best window lies between the alignments of its parts."""
    item = [f"w{i}" for i in range(100)]
    near = ["a", "b", "c", *item[3:50], *(f"x{i}" for i in range(6)), *item[50:97], "d", "e", "f"]
    docs = [{"doc_id": 1, "text": " ".join(["lead"] * 9 + near + ["tail"] * 9)}, {"doc_id": 2, "text": " ".join(item[:60])},
            {"doc_id": 3, "text": " ".join(item)}, {"doc_id": 4, "text": None}, {"doc_id": 5, "text": "w1 w2"}]
    items = [{"item_id": 7, "text": " ".join(item)}, {"item_id": 8, "text": "w1 w2"}]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = same(found.select("doc_id", "item_id", "similarity"), ORACLE["op5_decontaminate"], documents=docs, benchmark=items)
    assert {(d, i) for d, i, _ in got} >= {(1, 7), (3, 7), (5, 8)}
    assert 0.8 <= next(s for d, i, s in got if (d, i) == (1, 7)) < 0.82


def test_ownership_decides_in_sql_too(spark):
    values = ["hunter2", "correcthorse", "84620175", "Zk000000Lm2Pv5", "ab/cd==x9", "abcdefK7Lm2Pv5q", "Zk3Jq9Xw7Lm2Pv5"]
    rows = [(i, f"password={v}", "o1") for i, v in enumerate(values)]
    rows += [(20 + i, f"see x={v}, /{v}/y :{v}: {v}z é{v} y{v}", "o2") for i, v in enumerate(values)]
    rows += [(40, "password=changeme", "o1"), (41, "secret=your-example", "o1"), (42, "password: required", "o1")]
    rows += [(50 + i, "it is required here", f"p{i}") for i in range(4)] + [(60, "bare hunter2", "o2"), (61, None, None)]
    rows += [(70 + i, "token=widelyCopied12", f"q{i}") for i in range(3)]
    docs = [dict(zip(("doc_id", "text", "source"), r)) for r in rows]
    got = same(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")), ORACLE["op8_secrets"], documents=docs)
    assert sum("reuse" in r[-1] for r in got) >= len(values) + 1
