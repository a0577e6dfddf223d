import random

import corpus_pipeline
from skein.llm import toxicity

from test_decontaminate import best
from test_near_dedup import plain_components
from test_packing import ids
from test_secrets import plain

LIVE = "password=Zk3Jq9Xw7Lm2Pv5"


def test_stages(spark, words, tmp_path):
    rnd = random.Random(13)
    bad = ["vilefoo", "grubby", "snarl"]
    items = [(i, " ".join(rnd.choices(words, k=40))) for i in range(5)]
    docs, labels = [], []
    for i in range(420):
        w = rnd.choices(words, k=rnd.randint(30, 120))
        toxic = i % 7 == 0
        if toxic:
            w[5:5] = rnd.choices(bad, k=5)
        elif i % 20 == 1:
            w += items[i % 5][1].split()
        elif i % 20 == 2:
            w += [LIVE]
        elif i % 20 == 3:
            w = docs[i - 1][1].split()[:-1] + ["tail"]
        docs.append((i, " ".join(w), "en", f"s{i % 2}", len(w)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, None, None, None), (1001, "", "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sf = str(tmp_path)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = frame.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, sf)
        if name != "packing":
            assert frame.columns == columns
            frame.write.parquet(f"{sf}/{name}")
            frame = spark.read.parquet(f"{sf}/{name}")
            kept[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    scored = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    assert set(kept["toxicity"]) == {r["doc_id"] for r in scored.collect() if r["predicted"] == 0}
    assert not {i for i, _, t in labels if t} & set(kept["toxicity"]) and len(kept["toxicity"]) >= 0.99 * 362
    rows = list(kept["toxicity"].items())

    def smallest(rows):  # at similarity 0.8 the planted copies are the only links
        return {i for i, _, c in plain_components(rows) if i == c}
    assert set(kept["near_dedup"]) == smallest(rows)
    leaked = {i for i, t in kept["near_dedup"].items() if any(best(t or "", u) >= 0.8 for _, u in items)}
    assert leaked and set(kept["decontamination"]) == set(kept["near_dedup"]) - leaked
    assert set(kept["secrets"]) == set(kept["decontamination"])
    assert any(LIVE in (t or "") for t in kept["decontamination"].values())
    for i, t in kept["secrets"].items():
        assert t == (kept["decontamination"][i] or "").replace(LIVE, "[SECRET]") or t is None
        assert not plain(t)
    packed = frame.collect()
    for i, t in kept["secrets"].items():
        assert sum(r["length"] for r in packed if r["doc_id"] == i) == len(ids(t)) + 1
    assert {r["doc_id"] for r in packed} == set(kept["secrets"])
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
