"""No job of the near-duplicate search plans its inputs again for every count: the driver holds all plans."""

import numpy as np

from vitrine.llm import common, near_dedup


def test_plans_stay_small_when_nothing_is_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(80):  # a large group and texts of their own
        w = list(base)
        w[rng.integers(0, 60)] = f"e{i}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, " ".join(f"x{i}y{j}" for j in range(9))) for i in range(20)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    shuffles = []

    def cut(df, written=near_dedup.cut_lineage):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return written(df)

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(near_dedup, "cut_lineage", cut)
    out = near_dedup.near_dedup(docs, words=2)
    assert {r["component_id"] for r in out.where("doc_id < 80").collect()} == {0}
    assert out.where("doc_id >= 100 and not kept").count() == 0
    assert max(shuffles) <= 30
