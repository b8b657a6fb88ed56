"""Operators against brute force, on the small tables and on hand-made rows."""

import collections
import hashlib
import math
import re
import time
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import corpus_pipeline
from vitrine.llm import (
    bfd_packing, chat, components, decontaminate, exact_dedup, langid, near_dedup, online_packing, pii, quality,
    queries, secrets,
)
from vitrine.llm.tokens import encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string, row int, spans int, score int"


def documents(spark, texts, extra="x"):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(i, t, "en", "s", None, extra, 1, 2, 3) for i, t in texts], SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
LONG = " ".join(WORDS[(i * i + 3 * i) % 20] + str(i % 97) for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "ONE"), (5, "ONE"), (None, "null id"), (None, "null id"),
       (7, LONG), (8, LONG.upper()), (9, "¡ñandú! ☃"), (10, "two words"), (11, "a" * 50_000)]


@pytest.fixture(scope="module")
def real(spark):
    return {n: spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "benchmark", "labels", "conversations")}


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def rows(df):
    return [r.asDict() for r in df.collect()]


# --- tokens and packing

def test_ids_are_those_of_the_public_library():
    enc = encoder()
    texts = [t or "" for _, t in ODD if t != "a" * 50_000] + ["x <|endoftext|> y", " \n \n  a", "it's 12 £", "\0"]
    for t in texts:
        assert enc.ids(t).tolist() == [*enc.slow.encode(t, add_special_tokens=False).ids, 0]


def check_pieces(pieces, docs):
    enc, whole = encoder(), collections.Counter()
    for doc, text in docs:
        ids = enc.ids(text)
        whole[(doc, len(ids), zlib.crc32(ids.tobytes()))] += 1
    by_sequence = collections.defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert sum(p["length"] for p in pieces) == sum(n * k for (_, n, _), k in whole.items())
    text_of = dict(docs)
    for p in pieces:
        if p["doc_id"] is not None and len([d for d, _ in docs if d == p["doc_id"]]) == 1:
            ids = enc.ids(text_of[p["doc_id"]])
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    return by_sequence


def test_online_packing(real, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in real["documents"].collect()]
    by = check_pieces(rows(online_packing.pack_online(real["documents"])), docs)
    assert len(by) <= 1.05 * sum(len(encoder().ids(t)) for _, t in docs) / 1024 + 2
    check_pieces(rows(online_packing.pack_online(odd, open_windows=2)), ODD)
    assert online_packing.pack_online(empty).count() == 0


def test_padded_sequences(odd):
    made = rows(online_packing.sequences(online_packing.pack_online(odd, with_ids=True)))
    assert all(len(r["ids"]) // 4 == online_packing.padded_length(r["n_tokens"]) for r in made)
    assert [online_packing.padded_length(n) for n in (1, 3, 512, 1000, 1024)] == [1, 1024, 512, 1024, 1024]


def test_windows_hold_a_fixed_number():
    w = online_packing.Windows(100, 3, 10, online_packing._cut)
    closed = []
    for i, n in enumerate([60, 70, 80, 95, 30, 40, 100, 1]):
        closed += w.place((n, i, 0, np.zeros(n, np.uint32), n))
        assert len(w.open) <= 3
    assert all(sum(p[0] for p in c) <= 100 for c in closed)


def test_matrices(tmp_path, real, odd, empty):
    blocks = bfd_packing.write_matrices(odd, str(tmp_path / "m"), block_tokens=20_000)
    enc, text_of = encoder(), dict(ODD)
    total = 0
    for b in rows(blocks):
        matrix = np.frombuffer(b["ids"], "<u2").reshape(b["n_rows"], b["width"])
        assert b["cu_seqlens"][-1] == matrix.size and b["position_resets"] == b["cu_seqlens"][:-1]
        assert len(bfd_packing.position_ids(b["cu_seqlens"])) == matrix.size
        for s in b["segments"]:
            own = matrix[s["row"], s["offset"]:s["offset"] + s["length"]]
            total += s["length"]
            if s["doc_id"] not in (5, None):
                assert (own == enc.ids(text_of[s["doc_id"]])[s["start"]:s["start"] + s["length"]]).all()
    assert total == sum(len(enc.ids(t)) for _, t in ODD)
    assert bfd_packing.pack_matrices(empty).count() == 0


def test_best_fit_decreasing_is_best_fit():
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    row, offset, n = bfd_packing.best_fit_decreasing(lengths, 64)
    room = []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [r for r in range(len(room)) if room[r] >= lengths[i]]
        if not fits:
            room.append(64 - lengths[i])
        else:
            least = min(room[r] for r in fits)
            assert 64 - offset[i] == least
            room[row[i]] -= lengths[i]
    assert n == len(room) and (np.bincount(row, lengths) <= 64).all()


# --- exact deduplication

def low(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def check_exact(found, docs):
    groups = collections.defaultdict(list)
    for i, t in docs:
        groups[low(t)].append(i)
    assert len(found) == len(docs)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = collections.Counter()
    for r in found:
        ids = by_sha[r["text_sha256"]]
        assert r["doc_id"] in ids and r["group_size"] == len(ids)
        assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
        kept[r["text_sha256"]] += r["kept"]
    assert set(kept.values()) <= {1}


@pytest.mark.parametrize("digest_hex,share", [(64, 0.5), (1, 0.5), (64, 0.0), (64, 1.0)])
def test_exact_dedup(odd, digest_hex, share):
    check_exact(rows(exact_dedup.exact_dedup(odd, digest_hex=digest_hex, snapshot_share=share, shard_keys=4)), ODD)


def test_large_batch_against_a_small_snapshot(spark, monkeypatch, tmp_path):
    """No task screens much more of the batch than a filter holds."""
    docs = documents(spark, [(i, f"text {i % 900}") for i in range(1000)])
    made = exact_dedup.digests(docs)
    log, probe = str(tmp_path / "sizes"), exact_dedup._probe

    def noted(key, batch, filters):
        with open(log, "a") as f:
            f.write(f"{len(batch)}\n")
        return probe(key, batch, filters)

    monkeypatch.setattr(exact_dedup, "_probe", noted)
    for n, standing in enumerate((made.where("doc_id < 20"), made.where("false"))):
        snapshot = exact_dedup.publish(standing, str(tmp_path / f"snapshot{n}"), 50)
        hit = {r["digest"] for r in exact_dedup.screen(exact_dedup.grouped(made), snapshot).where("maybe").collect()}
        assert {r["digest"] for r in standing.collect()} <= hit and len(hit) < 60
    sizes = [int(x) for x in open(log)]
    assert sum(sizes) >= 1800 and max(sizes) < 120
    assert rows(exact_dedup.exact_dedup(docs, snapshot_share=0, shard_keys=50)) and exact_dedup.exact_dedup(docs, snapshot_share=0).where("kept").count() == 900


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_filter_never_rejects_its_keys():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 7, 5000):
        keys = rng.integers(0, 2**63, n).astype(np.uint64)
        f = exact_dedup.FuseFilter.build(keys)
        assert f.has(keys).all() and f.has(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.01


# --- near deduplication

def near_brute(docs, words, percent=80):
    def shingles(t):
        w = low(t).encode().split()
        return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets = [(i, shingles(t)) for i, t in docs]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (_, s) in enumerate(sets):
        for y in range(x):
            t = sets[y][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least.setdefault(root(x), []).append(i)
    return sorted((str(i), len(s), str(min((j for j in least[root(x)] if j is not None), default=None)))
                  for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_is_exact(spark, real, words):
    docs = [(r["doc_id"], r["text"]) for r in real["documents"].collect()]
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    for i in range(120):  # one large group of copies with few to many edits
        w = list(base)
        for j in rng.integers(0, 120, rng.integers(0, 12)):
            w[j] = f"e{rng.integers(0, 1 << 30)}"
        docs.append((100_000 + i, " ".join(w)))
    got = near_dedup.near_dedup(documents(spark, docs), words=words)
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows(got)) == near_brute(docs, words)


def test_one_document_linked_to_a_tight_group(spark):
    """Groups of 40 copies with one word changed, each with one document at 0.82."""
    docs, k, n = [], 5, 5000
    for seed in range(16):
        base = [f"s{seed}w{i}" for i in range(n)]
        texts = [[*base[:-1], f"last{i}"] for i in range(40)]
        far = list(base)
        for at in range(10, 10 + 98 * 50, 50):
            far[at] = f"far{at}"
        same = n - k + 1 - 98 * k
        assert 0.8 < same / (2 * (n - k + 1) - same) < 0.83
        docs += [(1000 * seed + i, " ".join(t)) for i, t in enumerate([*texts, far])]
    got = rows(near_dedup.near_dedup(documents(spark, docs)))
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i // 1000 * 1000 for i, _ in docs}


def test_near_dedup_of_odd_rows(odd, empty):
    got = rows(near_dedup.near_dedup(odd, words=2))
    assert sorted((str(r["doc_id"]), r["n_shingles"]) for r in got) == [x[:2] for x in near_brute(ODD, 2)]
    component = {r["doc_id"]: r["component_id"] for r in got}
    assert component[4] == component[5] == 4 and component[8] == 7 and component[2] == 2 and component[3] == 3
    assert near_dedup.near_dedup(empty).count() == 0


def test_trees_reach_the_recall():
    assert near_dedup.trees_for(0.999999, 0.8, 3) > near_dedup.trees_for(0.9, 0.8, 3) >= 2


def test_recall_holds_over_shared_positions():
    """Signatures drawn with a given number of agreeing positions, through the trees' own branching."""
    n, rng = 4000, np.random.default_rng(11)
    some = rng.integers(0, 1 << 32, (n, near_dedup.POSITIONS)).astype("<u4")
    for agreeing in (20, 40):
        other = some + np.uint32(1)
        for row, own in zip(other, some):
            at = rng.choice(near_dedup.POSITIONS, agreeing, replace=False)
            row[at] = own[at]
        met = 0
        for pair in range(n):
            nodes = []
            for sig in (some[pair:pair + 1], other[pair:pair + 1]):
                node = np.full(1, pair + 1, np.uint64)
                for _ in range(2):
                    _, node = near_dedup._children(node, np.repeat(sig, len(node), 0), 0.8)
                nodes.append(set(node.tolist()))
            met += bool(nodes[0] & nodes[1])
        want = near_dedup._met(agreeing, 0.8, 2)
        assert abs(met / n - want) < 5 * np.sqrt(want * (1 - want) / n)
    trees, least = near_dedup.trees_for(0.999999, 0.8, 3), near_dedup.least_for(0.999999, 0.8)
    missed = sum(p * (1 - near_dedup._passes(k, least) * (1 - (1 - near_dedup._met(k, 0.8, 3)) ** trees))
                 for k, p in enumerate(near_dedup._agreeing(0.8)))
    assert (trees, least) == (20, 34) and missed <= 1e-6


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (9, 5), (7, 7)] + [(100 + i, 101 + i) for i in range(40)] + [(200, i) for i in range(201, 240)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got[3] == 1 and got[9] == 4 and got[7] == 7 and got[140] == 100 and got[239] == 200


# --- languages and quality

def test_languages_of_held_out_documents(real, odd, empty):
    got = {r["doc_id"]: r for r in rows(queries.op4_language_id(odd.sparkSession, SF))}
    truth = {r["doc_id"]: r["lang"] for r in real["documents"].collect()}
    out = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sorted(i for i in got if got[i]["held_out"]) == sorted(out)
    assert np.mean([got[i]["lang_pred"] == truth[i] for i in out]) > 0.95
    model = langid.train(real["documents"])
    found = {r["doc_id"]: r for r in rows(langid.predict(odd, model))}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[7]["lang_pred"] != "und"
    assert langid.predict(empty, model).count() == 0
    none = langid.train(empty)
    assert {r["lang_pred"] for r in rows(langid.predict(odd, none))} == {"und"}


def test_more_languages_than_a_mask_has_bits(spark):
    texts = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}q" * 5) for i in range(80)]
    docs = documents(spark, texts).withColumn("lang", F.format_string("l%03d", F.col("doc_id")))
    model = langid.train(docs)
    assert len(model.planes) == 2
    assert all(r["lang_pred"] == f"l{r['doc_id']:03d}" for r in rows(langid.predict(docs, model)))


def test_quality(real, odd, empty):
    got = {r["doc_id"]: r for r in rows(queries.op7_quality(odd.sparkSession, SF))}
    label = {r["doc_id"]: r["quality"] for r in real["labels"].collect()}
    out = [i for i in label if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i in out)
    good, bad = ([got[i]["score"] for i in out if label[i] == y] for y in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.9
    known = real["labels"].select("doc_id", F.col("quality").alias("label"))
    model = quality.train(real["documents"], known)
    assert len(rows(quality.score(odd, model))) == len(ODD)
    assert quality.score(empty, model).count() == 0
    assert {r["score"] for r in rows(quality.score(odd, quality.train(empty, known)))} == {0.5}


# --- personal data and secrets

def luhn(digits):
    return sum(v if i % 2 == 0 else v * 2 - 9 * (v > 4) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m.group())


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
]
SECRETS = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 32),
]


def base(text, kinds):
    found = sorted((m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(kinds)
                   for m in re.compile(p, re.A).finditer(text or "") if ok(m))
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in found)


TRICKY = [
    "a@b.co_x@c.de, a@b.c@d.e é.x@y.z@ a@b..c %@-.-", "ñ ☃😀 me@x.org 1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.0255.3 0.0.0.0",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111114 4111  1111 1111 1111 0000000000000000",
    "+1 (555) 010-9999 ext +12 +3-4 +49 30 1234567 +1.2.3.4.5.6.7.8.9.0 ++44 20 7946 0958-", "1" * 20_000, "a." * 5000 + "@",
    "x@" + "a." * 5000 + "b", "- 5" * 5000,
    "password=hunter22 token: 'abc' secret=token=abcdefghi API_KEY\"=\"aaaaaaaa token:secret:abcdefgh PassWd = 12345678",
    "AKIAABCDEFGHIJKL AKIA123 xAKIAAKIAAKIAAKIA0 " + "0123456789abcdef" * 2 + " " + "f" * 31 + "G" + "a" * 33,
    "key 3fA9xQ7Lm2ZpR8sT4vWy1B and 123e4567-e89b-12d3-a456-426614174000 and 9f8e7d6c5b4a39281706f5e4",
]


@pytest.mark.parametrize("kinds,find,module", [(PII, pii.find_personal_data, pii), (SECRETS, secrets.find_secrets, secrets)])
def test_base_spans(spark, real, empty, kinds, find, module):
    docs = [(r["doc_id"], r["text"]) for r in real["documents"].collect()]
    docs += [(10**6 + i, t) for i, t in enumerate(TRICKY)] + [(i and -i, t) for i, t in ODD]
    got = collections.Counter((str(r["doc_id"]), r["base_sha256"]) for r in rows(module.digest(find(documents(spark, docs)))))
    want = collections.Counter((str(i), hashlib.sha256(base(t, kinds).encode()).hexdigest()) for i, t in docs)
    assert got == want
    assert module.digest(find(empty)).count() == 0


def test_disclosing_terms(spark):
    texts = [(i, f"The quartermaster Zorblatt wrote from zed@corp.example about stores and tents, day {i}.") for i in range(3)]
    texts += [(10 + i, f"The stores and tents were counted about noon, day {i}; wrote nobody.") for i in range(60)]
    docs = documents(spark, texts)
    found = {r["doc_id"]: r for r in pii.find_personal_data(docs).withColumn("s", pii.written("spans")).collect()}
    said = {texts[0][1][int(s.split(":")[1]):int(s.split(":")[2])] for s in found[0]["s"].split(",")}
    assert {"Zorblatt", "quartermaster", "zed@corp.example"} <= said and "stores" not in said and "wrote" not in said
    assert not found[10]["s"]
    joined = docs.select("doc_id", "text").join(pii.find_personal_data(docs), "doc_id")
    clean = {r[0]: r[1] for r in joined.select("doc_id", pii.sanitised(F.col("text"), F.col("spans"))).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[10] == texts[3][1]


def test_disclosing_terms_far_from_the_entity(spark):
    """Every occurrence is marked, however far from the entity."""
    far = " and the stores and tents were counted about noon" * 6
    texts = [(i, f"Wrote <zed@corp.example> to us{far}; then ZORBLATT left, day {i}. Zorblatt") for i in range(3)]
    texts += [(10 + i, f"The stores and tents were counted about noon, day {i} and wrote nobody; then left.") for i in range(60)]
    found = {r["doc_id"]: r["s"] for r in pii.find_personal_data(documents(spark, texts)).withColumn("s", pii.written("spans")).collect()}
    said = [texts[0][1][int(s.split(":")[1]):int(s.split(":")[2])] for s in found[0].split(",")]
    assert sorted(said) == ["ZORBLATT", "Zorblatt", "zed@corp.example"] and not found[10]


def test_disclosing_terms_of_whole_texts(spark):
    """Every occurrence, however far away, of an entity in a single document; copies are no evidence."""
    far = " and the stores and tents were counted about noon" * 6
    texts = [(0, f"Zorblatt <zed@corp.example> wrote{far}; then ZORBLATT left." + " Zorblatt" * 2)]
    texts += [(10 + i, f"The stores and tents were counted about noon, day {i} and wrote nobody; then left.") for i in range(60)]
    texts += [(100 + i, "The clerk wrote to ann@corp.example; stores were counted.") for i in range(50)]
    texts += [(200 + i, f"The clerk counted the tents at noon, day {i}.") for i in range(30)]
    found = {r["doc_id"]: r["s"] for r in pii.find_personal_data(documents(spark, texts)).withColumn("s", pii.written("spans")).collect()}
    said = [texts[0][1][int(s.split(":")[1]):int(s.split(":")[2])] for s in found[0].split(",")]
    assert sorted(said) == ["ZORBLATT"] + ["Zorblatt"] * 3 + ["zed@corp.example"]
    assert {found[100 + i] for i in range(50)} == {"email:19:35"} and not found[10] and not found[200]


def test_entropy_spans(spark):
    docs = documents(spark, [(0, TRICKY[-1]), (1, "a plain sentence with averyveryverylongwordwithoutdigits in it"),
                             (2, "id aaaaaaaaaaaaaaaaaaaaaaaaa1A ")])
    found = {r["doc_id"]: r["s"] for r in secrets.find_secrets(docs).withColumn("s", secrets.written("spans")).collect()}
    kinds = [s.split(":")[0] for s in found[0].split(",")]
    assert kinds == ["entropy_mixed", "entropy_hex"] and not found[1] and not found[2]


def test_keys_of_every_class(spark):
    keys = {"entropy_lower": "key-3ax6xnjp29jd6fds4gc373sgvjxteol0", "entropy_upper": "JBSWY3DPEHPK3PXPQ4TZ6W2NRA5VKM7C",
            "entropy_upper_hex": "9F8E7D6C5B4A39281706F5E4", "entropy_letters": "qTzRbWmXkLpVfHsNcJgD",
            "entropy_hex": "9f8e7d6c5b4a39281706f5e4", "entropy_mixed": "3fA9xQ7Lm2ZpR8sT4vWy1B"}
    words = ["getElementForIdentifierName", "Either/Or-Something-Else", "MAXIMUM_ALLOCATION_SIZE_2048", "some-article-about-things-2024",
             "123e4567-e89b-12d3-a456-426614174000", "aaaaaaaaaaaaaaaaaaaaaaa1", "AAAAAAAAAAAAAAAAAAAAaaaa"]
    docs = documents(spark, [(i, f"the {x} here") for i, x in enumerate([*keys.values(), *words])])
    found = {r["doc_id"]: r["s"] for r in secrets.find_secrets(docs).withColumn("s", secrets.written("spans")).collect()}
    assert [found[i].split(":")[0] for i in range(len(keys))] == [*keys] and not any(found[len(keys) + i] for i in range(len(words)))
    rng = np.random.default_rng(4)
    alphabets = ("0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF", secrets.MIXED[:64])
    many = ["".join(rng.choice(list(a), 24)) for a in alphabets for _ in range(200)]
    got = secrets.find_secrets(documents(spark, list(enumerate(many)))).where(F.size("spans") > 0).count()
    assert got >= 0.98 * len(many)


def test_what_stands_beside_a_key_does_not_hide_it(spark):
    key = "3fA9xQ7Lm2ZpR8sT4vWy1B"
    for_hex = "0123456789abcdef" * 2
    texts = [f"/samples/keys/{key}", f"{for_hex}/{key}", f"{key}/{for_hex}", f"dummy-{key}-example", f"https://x.org/a/sample/{key}=", f"/keys/{key}xxxx"]
    found = {r["doc_id"]: r for r in secrets.find_secrets(documents(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts[:5]):
        at = t.index(key)
        hot = [s for s in found[i]["spans"] if s["kind"] == "entropy_mixed"]
        assert len(hot) == 1 and hot[0]["start"] <= at + 2 and hot[0]["end"] >= at + len(key) - 2
    assert not found[5]["spans"]


def disclosed(texts):
    """Brute force: per text its disclosing terms and whether they are removed."""
    word = regex.compile(r"[\p{L}\p{N}]+")
    whole = collections.Counter(texts)
    n, chars = len(whole), sum(map(len, whole))
    n_term, names, inside = collections.Counter(), {}, {}
    for t in whole:
        n_term.update({w for w in word.findall(t.lower()) if regex.search(r"\p{L}", w)})
        spans = sorted((m.start(), r, k, m.end()) for r, (k, p, ok) in enumerate(PII) for m in re.compile(p, re.A).finditer(t) if ok(m))
        rest, at, names[t] = "", 0, set()
        for start, _, kind, end in spans:
            value, number = t[start:end].lower(), re.sub("[^0-9]", "", t[start:end])
            group = {"email": value.rsplit("@", 1)[-1], "ip": ".".join(value.split(".")[:3]), "phone": number[:5], "card": number[:6]}[kind]
            names[t] |= {f"{kind}:{value}", f"{kind}~{group}"}
            if start >= at:
                rest, at = rest + t[at:start] + " ", end
        inside[t] = collections.Counter(w for w in word.findall((rest + t[at:]).lower()) if regex.search(r"\p{L}", w))
    joint, n_pair, n_entity, of_chars = (collections.Counter() for _ in range(4))
    for t in whole:
        for e in names[t]:
            n_entity[e] += 1
            of_chars[e] += len(t)
            for w, c in inside[t].items():
                joint[e, w] += c
                n_pair[e, w] += 1
    share, examined = {}, sum(len(names[t]) * len(inside[t]) for t in whole)
    for (e, w), c in joint.items():
        spread = max(n_term[w], n_pair[e, w])
        base_rate, part, events = n_entity[e] / n, of_chars[e] / chars, c + spread - n_pair[e, w]
        own = math.log2(n) if "~" in e[:6] else -math.log2(base_rate)
        q = c / events
        evidence = 0.0 if q <= part or part >= 1 else events * (
            q * math.log(q / part) + ((1 - q) * math.log((1 - q) / (1 - part)) if q < 1 else 0))
        told = math.log2((n_pair[e, w] + base_rate) / (spread + 1) / base_rate) / own if own > 0 else 0
        if told >= pii.GENERALISE and evidence >= math.log(examined / pii.CHANCE) and spread <= pii.LEFT_OPEN * n_pair[e, w]:
            share[e, w] = told
    return {t: {w: max(share[e, w] for e in names[t] if (e, w) in share) >= pii.REMOVE
                for w in inside[t] if any((e, w) in share for e in names[t])} for t in whole}


def test_disclosing_terms_by_brute_force(spark, real):
    """On the real table and with planted persons; common words stay, whatever stands beside them once."""
    texts = [r["text"] or "" for r in real["documents"].collect()]
    texts += [f"Zorblatt of Quux wrote from zed@corp.example, {w}. Zorblatt signed." for w in WORDS[:5]]
    texts += [f"Ploverton office: user{i}@plover.example, ask for {w}, Ploverton." for i, w in enumerate(WORDS[:4])] * 2
    found = pii.find_personal_data(documents(spark, list(enumerate(texts)))).collect()
    want = disclosed(texts)
    words = marked = 0
    for r in found:
        t = texts[r["doc_id"]]
        got = {t[s["start"]:s["end"]].lower(): s["kind"] == "term_removed" for s in r["spans"] if s["kind"].startswith("term")}
        assert got == want[t]
        if r["base"] and r["doc_id"] < len(texts) - 13:
            words += len(regex.findall(r"[\p{L}\p{N}]+", t))
            marked += len(r["spans"]) - len(r["base"])
    assert {"zorblatt", "quux"} <= want[texts[-13]].keys() and "ploverton" in want[texts[-1]]
    print("marked", marked, "of", words)
    assert marked <= 0.05 * words


def test_many_matches_in_one_text(spark):
    n = 60_000
    text = " ".join(f"u{i}@x.org" for i in range(n))
    began = time.monotonic()
    found = spark.createDataFrame([(text,)], "t string").select(pii.base_spans(F.col("t")).alias("s")).select(
        F.size("s"), F.get("s", F.lit(n - 1))).first()
    assert found[0] == n and (found[1]["start"], found[1]["end"]) == (len(text) - len(f"u{n - 1}@x.org"), len(text))
    assert time.monotonic() - began < 60


def test_paths_and_identifiers_are_no_secrets(spark):
    plain = ["/Users/alice/project2/src/Main/java", "convertUtf8ToUtf16LittleEndian", "https://example.org/docs/2024/Release/notes/index",
             "https://site.org/docs/v2/Release/notes/index/page", "src/Python3/lib/SitePackages/numpy",
             "/Volumes/Data1/backup/photos/holiday", "Iso8601DateTimeFormatterBuilder", "en_US/LC2/Messages/gettext/catalog"]
    found = secrets.find_secrets(documents(spark, [(i, f"see {t} here") for i, t in enumerate(plain)])).collect()
    assert not [plain[r["doc_id"]] for r in found if r["spans"]]
    rng = np.random.default_rng(6)
    keys = ["".join(rng.choice(list(secrets.MIXED[:62]), n)) for n in (16, 17, 18, 19) for _ in range(100)]
    got = secrets.find_secrets(documents(spark, list(enumerate(keys)))).where(F.size("spans") > 0).count()
    assert got >= 0.95 * len(keys)


def test_entropy_by_recount(spark):
    def entropy(w):
        return -sum(c / len(w) * np.log2(c / len(w)) for c in collections.Counter(w).values())

    rng = np.random.default_rng(2)
    values = ["".join(rng.choice(list("0123456789abcdef"[:k]), n)) for k, n in ((16, 40), (4, 30), (10, 100), (12, 15), (9, 64))]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(
        "v", secrets.hot_range(F.col("v"), secrets.HEX, 2.8).alias("r")).collect()
    for r in got:
        hot = [i for i in range(len(r["v"]) - 15) if entropy(r["v"][i:i + 16]) >= 2.8 - 1e-12]
        assert (r["r"]["lo"], r["r"]["hi"]) == ((hot[0], hot[-1] + 16) if hot else (-1, -1))


# --- decontamination

def test_decontamination(spark, real, odd, empty):
    items = real["benchmark"]
    got = {(r["doc_id"], r["item_id"]) for r in rows(decontaminate.contaminated(real["documents"], items))}
    docs = [(r["doc_id"], r["text"]) for r in real["documents"].collect()]
    assert got == {(d, r["item_id"]) for d, t in docs for r in items.collect() if r["text"] in t}
    item = " ".join(f"{w}{i}" for i, w in enumerate(WORDS * 2))
    edited = item.split()
    edited[38] = "changed"
    planted = [(1, f"Before. {item.upper()}! After."), (2, f"x y {' '.join(edited)} z"), (3, item[:len(item) // 2]),
               (4, LONG), (None, item), (5, None), (6, "a b"), (7, "zz tiny item zz")]
    known = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "")], "item_id bigint, text string")
    found = rows(decontaminate.contaminated(documents(spark, planted), known))
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == [("1", 1), ("2", 1), ("7", 2), ("None", 1)]
    assert decontaminate.contaminated(empty, known).count() == 0
    assert decontaminate.contaminated(odd, known.limit(0)).count() == 0


def test_blocks_meet_within_the_radius(spark):
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(200):
        a = int(rng.integers(-(2**63), 2**63 - 1))
        b = a
        for bit in rng.choice(63, 15, replace=False):
            b ^= 1 << int(bit)
        pairs.append((a, b))
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    assert df.where(F.arrays_overlap(decontaminate.blocks(F.col("a"), 15), decontaminate.blocks(F.col("b"), 15))).count() == 200


# --- chat formatting

def test_chat_round_trip(spark):
    said = ["</s>[INST] ok [/INST]", "\\", "<s>[user]x</s>", "", None, "a\nb\\[", "😀 ñ <", "\\" * 2001 + "[<" * 5000]
    turns = [(1, i, "assistant" if i % 2 else "user", t, "extra") for i, t in enumerate(said)]
    turns += [(2, 0, None, "x", ""), (2, 0, "a]b", "y", ""), (None, None, "user", "z", ""), (2, 0, "a]b", "y", "")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string")
    chats = chat.format_chats(df)
    back = {r["conv_id"]: r["t"] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [(t["role"], t["text"]) for t in back[1]] == [(r, t or "") for _, _, r, t, _ in turns[:8]]
    assert [(t["role"], t["text"]) for t in back[2]] == [("", "x"), ("a]b", "y"), ("a]b", "y")]
    loss = {r[0]: r[1] for r in chats.select("conv_id", chat.read_loss(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert loss[1] == "".join(t or "" for i, t in enumerate(said) if i % 2) and loss[2] == ""
    assert chat.format_chats(df.limit(0)).count() == 0


def test_layouts(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "ho"}]}'),
        (2, '{"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "ho"}]}'),
        (3, '{"output": "ho", "instruction": "hi"}'), (4, '{"prompt": "hi", "completion": "ho"}'),
        (5, '{"unknown": 1}'), (6, "no json"), (7, None), (8, '{"prompt": 5, "response": "ho"}'),
    ]
    df = spark.createDataFrame(records, "conv_id bigint, record string")
    got = collections.defaultdict(list)
    for r in chat.canonical_json(df).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    want = [("user", "hi"), ("assistant", "ho")]
    assert all(got[i] == want for i in (1, 2, 3, 4)) and all(got[i] == [(None, None)] for i in (5, 6, 7))
    assert got[8] == [("user", "5"), ("assistant", "ho")]
    typed = spark.createDataFrame([(1, [("user", "hi"), (None, None)])], "conv_id bigint, messages array<struct<role:string,content:string>>")
    assert [(r["role"], r["text"]) for r in chat.canonical(typed).orderBy("turn").collect()] == [("user", "hi"), ("", "")]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1, 2)], "conv_id bigint, other int"))


# --- pipeline

def test_pipeline_by_stages(spark, real):
    docs = real["documents"]
    kept = docs
    for (name, stage) in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r["text"] for r in kept.collect()}
        kept = corpus_pipeline.cut_lineage(stage(spark, kept, SF))
        after = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert kept.columns == docs.columns
        if name == "language":
            assert after == before
        if name == "exact_duplicates":
            top = {}
            for i, t in before.items():
                top[low(t)] = max(i, top.get(low(t), i))
            assert sorted(after) == sorted(top.values())
        if name == "near_duplicates":
            assert sorted(map(str, after)) == sorted({x[2] for x in near_brute(list(before.items()), 5)})
        if name == "benchmark_leaks":
            leaks = [r["text"] for r in real["benchmark"].collect()]
            assert sorted(after) == sorted(i for i, t in before.items() if not any(x in t for x in leaks))


def test_pipeline_of_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        docs.count()
    assert corpus_pipeline._one_row_each(odd).count() == len(ODD) - 2
    kept = corpus_pipeline.exact_duplicates(spark, odd, SF)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["2", "3", "5", "None", "8", "9", "10", "11"])


def test_stages_decide_on_rows_not_on_ids(spark, real):
    """Null and repeated ids over clean and rejected texts, in every stage that drops."""
    def text(seed, n=60, end=""):
        rng = np.random.default_rng(seed)
        return " ".join(rng.choice(WORDS, n)) + " " + str(seed) + " words of their own" + end

    def after(stage, given):
        got = corpus_pipeline.cut_lineage(stage(spark, documents(spark, given), SF))
        assert got.columns == documents(spark, []).columns
        return sorted((str(r["doc_id"]), r["text"]) for r in got.collect())

    def want(*kept):
        return sorted((str(i), t) for i, t in kept)

    clean = [(None, text(1)), (None, text(2)), (7, text(3)), (8, text(4))]
    leak = max((r["text"] for r in real["benchmark"].collect()), key=len)
    assert after(corpus_pipeline.language, clean + [(None, "12 34 !"), (7, "5 6"), (9, "7")]) == want(*clean)
    assert after(corpus_pipeline.exact_duplicates, clean + [(None, text(3).upper()), (7, text(4))]) == want(*clean)
    assert after(corpus_pipeline.benchmark_leaks, clean + [(None, leak), (7, leak), (9, leak)]) == want(*clean)
    # ids: the smallest, a null one only if there is no other; 8 stays beside its near copy under 9
    near = [(None, text(3, end=" x")), (9, text(4, end=" x")), (7, text(5)), (7, text(5, end=" x")), (9, text(6))]
    got = after(corpus_pipeline.near_duplicates, clean + near)
    fives = [x for x in got if x[1].startswith(text(5))]
    assert len(fives) == 1 and sorted(set(got) - set(fives)) == want(*clean, (9, text(6)))
    nulls = after(corpus_pipeline.near_duplicates, [(None, text(1)), (None, text(1, end=" x")), (None, text(2))])
    assert len(nulls) == 2 and ("None", text(2)) in nulls
    one = [(None, text(1)), (5, text(1, end=" x")), (6, text(2)), (4, text(2, end=" x")), (3, "")]
    assert after(corpus_pipeline.near_duplicates, one) == want(one[1], one[3], one[4])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name]).to_arrow_table()
    got = queries.QUERIES[name](spark, SF).toArrow()
    order = sorted(want.column_names)
    assert sorted(got.column_names) == order
    assert sorted(map(str, got.select(order).to_pylist())) == sorted(map(str, want.select(order).to_pylist()))
