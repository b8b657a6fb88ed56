"""Terms of crowded entities, frequent words and copies: as if every pair of entity and term had been weighed."""

import random

import pytest

from tests.llm.test_llm import disclosed, documents
from vitrine.llm import pii


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_left_unbuilt_could_not_pass(spark, seed):
    rng = random.Random(seed)
    common = [f"common{'abcdefgh'[i % 8]}{i}x" for i in range(30)]
    texts = []
    for g, size in enumerate((1, 2, 3, 5, 8, 9, 10, 11, 12, 14, 20, 60)):  # groups below and beyond n^0.4 documents
        for i in range(size):
            secret = [f"secret{g}q"] * rng.choice((1, 2, 3)) + [f"own{g}u{i}"] * rng.choice((0, 1, 2, 3))
            words = rng.choices(common, k=12) + secret
            rng.shuffle(words)
            texts.append(f"{' '.join(words)} p{i}@group{g}.example {rng.choice(common)}")
    for g in range(12):  # the words stand elsewhere too, once to many times as often
        texts += [f"{' '.join(rng.choices(common, k=12))} secret{g}q n{g}v{i}" for i in range(rng.choice((0, 1, 4, 40)))]
    texts += [f"{' '.join(rng.choices(common, k=12))} filler{i}z" for i in range(300)]
    texts += rng.choices(texts, k=60)
    want, marked = disclosed(texts), set()
    for r in pii.find_personal_data(documents(spark, list(enumerate(texts)))).collect():
        t = texts[r["doc_id"]]
        got = {t[s["start"]:s["end"]].lower(): s["kind"] == "term_removed" for s in r["spans"] if s["kind"].startswith("term")}
        assert got == want[t]
        marked |= got.keys()
    assert any(w.startswith("own") for w in marked) and any(w.startswith("secret") for w in marked)
