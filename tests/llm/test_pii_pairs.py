"""Pairs of entity and term that fail whatever their counts are never built."""

from pyspark.sql import functions as F

from vitrine.llm import pii


def _docs(spark):
    filler = [" ".join(f"w{(i * 7 + j) % 50}x" for j in range(20)) for i in range(160)]
    texts = [f"{filler[i]} user{i}@mail.example the the offer" for i in range(80)]  # a group of 80 documents
    texts += [f"{filler[i]} the offer" for i in range(80, 160)]
    texts += [f"the zebrafish zebrafish zebrafish wrote {filler[k]} from ann@rare.test the" for k in range(6)]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def _spans(docs):
    return sorted(map(tuple, pii.digest(pii.find_personal_data(docs)).select("doc_id", "spans").collect()))


def test_hopeless_pairs_are_not_built(spark, monkeypatch):
    written, cut = [], pii.cut_lineage

    def spy(df):
        out = cut(df)
        written.append(out)
        return out

    monkeypatch.setattr(pii, "cut_lineage", spy)
    got = _spans(_docs(spark))
    assert any("term_" in s for _, s in got)
    pairs = [f for f in written if {"entity", "term", "n_pair", "joint"} <= set(f.columns)][-1]
    entities = {r[0] for r in pairs.select("entity").distinct().collect()}
    assert "email:ann@rare.test" in entities and "email~mail.example" not in entities
    # the group's texts have hundreds of pairs, none of which could pass
    assert pairs.count() < 20


def test_frequent_terms_change_no_span(spark, monkeypatch):
    want = _spans(_docs(spark))
    monkeypatch.setattr(pii, "FREQUENT", 10**9)  # every term beyond 48 documents is known as frequent
    assert _spans(_docs(spark)) == want
    monkeypatch.setattr(pii, "FREQUENT", 1)  # none is
    assert _spans(_docs(spark)) == want


def test_counted_terms(spark):
    rows = [(["b", "a", "b"],), ([],), (["c"],), (["a"] * 3 + ["é"],)]
    got = spark.createDataFrame(rows, "t array<string>").select(pii._counted(F.col("t")).alias("c")).collect()
    assert [[tuple(x) for x in r["c"]] for r in got] == [[("a", 1), ("b", 2)], [], [("c", 1)], [("a", 3), ("é", 1)]]
