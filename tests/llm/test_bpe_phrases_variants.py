"""Byte-level BPE, collocations and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from vitrine.llm import collocations, piece_bpe, queries, variants
from tests.llm.test_llm import ODD, SF, documents


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()
    return [(r.doc_id, r.text or "", r.lang or "und") for r in rows]


# --- byte-level BPE ---------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                             mergeable_ranks=piece_bpe.read_ranks(piece_bpe.VOCABULARY), special_tokens={})


def test_bpe_query_equals_the_library(spark, texts, library):
    got = {r.doc_id: r for r in queries.op11_byte_bpe(spark, SF).collect()}
    assert len(got) == len(texts)
    for doc_id, text, _ in texts:
        ids = library.encode_ordinary(text)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_odd_rows(spark, library):
    got = piece_bpe.decode(piece_bpe.encode(documents(spark, ODD))).collect()
    want = sorted((-1 if i is None else i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in ODD)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids, bytes(r.decoded)) for r in got) == want
    assert piece_bpe.encode(documents(spark, [])).count() == 0


def ids_of(code, text):
    return np.frombuffer(code.ids(text), np.int32)


def back(code, text):
    return b"".join(code.pieces(ids_of(code, text)))


def test_bpe_random_unicode(library):
    rng = random.Random(5)
    code = piece_bpe.codec()
    alphabet = "aeté  \n\t \u0085\u001c'sdlr'09²Ⅷ漢字🙂́_-#<|endoftext|>\u0000"
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    newer = [0x558, 0x88F, 0xA7CE, 0x11DE0, 0x3D276, 0x323B0]  # letters and numbers of later Unicode versions
    for _ in range(20_000):
        text = "".join(rng.choice(alphabet) if rng.random() < 0.8 else chr(rng.choice(rng.choice((points, newer))))
                       for _ in range(rng.randrange(40)))
        assert ids_of(code, text).tolist() == library.encode_ordinary(text), ascii(text)
        assert back(code, text) == text.encode()
    long = "na" * 200_000
    assert back(code, long) == long.encode()


def test_every_entry_is_reached_by_merges():
    code = piece_bpe.codec()
    assert all(code.model.encode(piece_bpe.as_points(code.bytes_of[i])) == [i] for i in range(len(code.ranks)))


def test_unknown_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, [64, None, -5, 10**6, 65]), (2, None), (None, [])], "doc_id bigint, ids array<int>")
    assert [bytes(r.decoded) for r in piece_bpe.decode(rows).collect()] == [b"ab", b"", b""]


def test_ranks_with_gaps(tmp_path, library):
    """A file that leaves ranks out: ids are ranks, not places."""
    import base64

    ranks = {t: 3 * r for t, r in piece_bpe.read_ranks(piece_bpe.VOCABULARY).items() if r < 1000}
    path = tmp_path / "gaps.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    code = piece_bpe.Codec(str(path))
    import public_tokenizers
    import tiktoken

    other = tiktoken.Encoding("gaps", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    text = "The theatre there is another one, isn't it? 2024"
    assert ids_of(code, text).tolist() == other.encode_ordinary(text)
    assert back(code, text) == text.encode()
    with pytest.raises(ValueError):
        piece_bpe.serialised_model([b"a"])


# --- collocations -----------------------------------------------------------------------

def brute_collocations(rows, min_count=10, per_lang=2000, percent=50):
    f, total = Counter(), Counter()
    for lang, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        for piece in re.split("[.,;:!?\n-\r]", text):
            ws = re.findall("[^ \t]+", piece)
            total[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, *ws[i:i + k]) for i in range(len(ws) - k + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= min_count}
    out = []
    for lang in total:
        mine = []
        for p, a in cands.items():
            if p[0] != lang:
                continue
            around = [b for q, b in cands.items() if q[0] == lang and len(q) > len(p)
                      and any(q[i:i + len(p) - 1] == p[1:] for i in range(1, len(q)))]
            if any(100 * b >= percent * a for b in around):
                continue
            cuts = []
            for k in range(1, len(p) - 1):
                left, right = f[(lang, *p[1:1 + k])], f[(lang, *p[1 + k:])]
                cuts.append((1_000_000 * a * a // (left * right), k, left, right))
            score, _, left, right = min(cuts)
            mine.append((-score, -a, " ".join(p[1:]).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(mine)[:per_lang], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrase_docs(spark, rows):
    return spark.createDataFrame([(lang, t, 1, 2, "x", "y") for lang, t in rows],
                                 "lang string, text string, n bigint, id int, word string, shard string")


def made_rows(seed=1, n=300):
    rng = random.Random(seed)
    vocabulary = [w + s for w in ("ka", "lo", "mi", "né", "Ru", "☃", "x_1", "\x00b") for s in ("", "r", "TT", " y")]
    def text():
        return "".join(rng.choice(vocabulary[:rng.choice((4, 12, 32))]) + rng.choice((" ", " ", "  ", "\t", ". ", ",", "\x0b"))
                       for _ in range(rng.randrange(60)))
    return [(rng.choice(("en", "en", "de", None)), rng.choice((text(), text(), None, ""))) for _ in range(n)]


@pytest.mark.parametrize("id_bits", [33, 42])
def test_collocations_equal_brute_force(spark, id_bits):
    rows = made_rows(n=1500)
    got = collocations.collocations(phrase_docs(spark, rows), id_bits=id_bits).select(COLUMNS).collect()
    want = brute_collocations([(lang or "und", t or "") for lang, t in rows])
    assert len(want) > 100 and {w[0] for w in want} == {"en", "de", "und"}
    assert sorted(map(tuple, got)) == want


def test_words_whose_hashes_meet(spark, monkeypatch):
    """With seven hash values for all words, nearly all get ids of their own."""
    monkeypatch.setattr(collocations, "_hash", lambda word, seed, bits: zlib.crc32(word) % 7 + 1)
    rows = made_rows(2)
    docs = phrase_docs(spark, rows)
    words = collocations.word_counts(docs)
    ids = [r.id for r in words.collect()]
    assert len(set(ids)) == len(ids) and sum(i >= 1 << 41 for i in ids) >= len(ids) - 7
    # the hash of workers is the original one, so the map of own ids is what they take
    assert words.where(F.col("id") < 1 << 41).count() <= 7


def test_spaces_are_the_same_in_both_engines():
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    library = tiktoken.Encoding("spaces", pat_str=r"\s", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    assert bytes(library.encode_ordinary(every)).decode() == "".join(regex.findall(r"\s", every))


def test_a_long_text_is_cut_without_loss(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(40)}" for _ in range(200_000)]
    rows = [("en", " ".join(words)), ("en", "w1 w2 w3")]
    got = collocations.collocations(phrase_docs(spark, rows), per_lang=10**6).select(COLUMNS).collect()
    pairs = Counter(zip(words, words[1:]))
    pairs[("w1", "w2")] += 1
    pairs[("w2", "w3")] += 1
    by_phrase = {r.phrase: r.a for r in got if r.phrase.count(" ") == 1}
    assert len(by_phrase) == len([p for p in pairs.values() if p >= 10])
    assert by_phrase == {" ".join(p): a for p, a in pairs.items()}


def test_counting_starts_anew_without_loss(monkeypatch):
    """A task that numbers words anew in the middle of texts, and sends filters many times."""
    monkeypatch.setattr(collocations, "HELD_WORDS", 3)
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh") * rng.choice((1, 2)) for _ in range(rng.choice((5, 300)))) for _ in range(60)]
    bitmap = np.full(collocations.BITMAP_BITS // 8, 255, np.uint8)
    phrases = collocations._Phrases({}, bitmap, 42, 6)
    sent = []
    for t in texts:
        sent += phrases.add("en", t)
    phrases.open.extend([0, 0])
    phrases.count()
    sent += phrases.sent()
    found, name = Counter(), {}
    for c in "abcdefgh":
        for w in (c, c + c):
            name[collocations._hash(w.encode(), collocations._seed(b"en"), 42)] = w
    for shard, data in sent:
        hi, lo, n = collocations.from_filter(data, shard, 6)
        for *ids, k in zip(*collocations.unpacked(*collocations.unpermuted(hi, lo)), n):
            found[tuple(name[int(i)] for i in ids if i)] += int(k)
    want = Counter()
    for t in texts:
        ws = t.split()
        want.update(zip(ws, ws[1:]))
        want.update(zip(ws, ws[1:], ws[2:]))
    assert len(sent) > 60 and found == want


@pytest.mark.parametrize("shard_bits", [0, 1, 6, 13, 16])
def test_filters_are_lossless(shard_bits):
    rng = np.random.default_rng(shard_bits)
    for size in (1, 2, 7, 8, 9, 1000, 5000):
        ids = [rng.integers(0, 1 << 42, size, dtype=np.uint64) for _ in range(3)]
        hi, lo = collocations.permuted(*collocations.packed(*ids))
        back = collocations.unpacked(*collocations.unpermuted(hi, lo))
        assert all((x == y).all() for x, y in zip(ids, back))
        if shard_bits:  # all keys of one shard
            hi = hi >> np.uint64(shard_bits) | np.uint64(1) << np.uint64(64 - shard_bits)
        n = rng.choice([1, 2, 254, 255, 256, 10**12], size)
        key = collocations.merged(np.repeat(hi, 2), np.repeat(lo, 2), np.repeat(n, 2))
        assert (key[2] % 2 == 0).all()
        data = collocations.to_filter(*key, shard_bits)
        again = collocations.from_filter(data, 1 if shard_bits else 0, shard_bits)
        assert all((x == y).all() for x, y in zip(key, again))


def test_scores_are_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 3 * 10**13 + 1, 10**13 + 9), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 10, 11)]
    got = spark.createDataFrame(rows, "a bigint, l bigint, r bigint").select(
        "a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s")).collect()
    assert [(r.a, r.l, r.r, r.s) for r in got] == [(a, x, y, 10**6 * a * a // (x * y)) for a, x, y in rows]


def test_collocations_of_nothing(spark):
    for rows in ([], [(None, None)], [("en", "few words")]):
        assert collocations.collocations(phrase_docs(spark, rows)).count() == 0


# --- spelling variants ------------------------------------------------------------------

def brute_words(rows, min_count=5):
    n = Counter()
    for doc_id, text in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", text):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= min_count}


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    out, forms = [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, k in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * k else None
    for w, k in words.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, k, len(near[w]), words.get(forms[w])))
    return sorted(out, key=lambda r: r[0])


def variant_rows(table):
    return sorted(((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in table.collect()), key=lambda r: r[0])


def test_variants_query_equals_brute_force(spark, texts):
    words = brute_words([(i, t) for i, t, _ in texts])
    got = variant_rows(queries.op13_spelling_variants(spark, SF))
    assert got == brute_variants(words)
    assert sum(r[1] is not None for r in got) > 5


@pytest.mark.parametrize("pairs_per_key", [0, 3, 4096])
def test_near_words_of_a_crowded_alphabet(spark, pairs_per_key):
    """Three letters only: every chunk is shared, and is cut to the last code point."""
    rng = random.Random(7)
    words = {}
    while len(words) < 700:
        words["".join(rng.choice("abé") for _ in range(rng.choice((6, 7, 8, 11))))] = rng.choice((5, 6, 30, 31, 200, 1100))
    table = spark.createDataFrame(list(words.items()), "word string, n bigint")
    got = variant_rows(variants.group_variants(table, pairs_per_key=pairs_per_key))
    want = brute_variants(words)
    assert got == want
    assert max(r[4] for r in want) > 5 and any(r[2] != r[0] and r[2] != r[1] for r in want)


def test_variants_odd_rows(spark):
    many = [(i, "Straßenbahn straßenbahn STRAßENBAHN ÉTUDIER étudier") for i in range(1, 40)]
    many += [(None, "étudier Étudier"), (None, "étudie" * 3), (1, None), (1, ""), (2, "x" * 30_000)]
    words = brute_words(many)
    assert words
    assert variant_rows(variants.group_variants(variants.word_counts(documents(spark, many)))) == brute_variants(words)
    none = variants.word_counts(documents(spark, [(1, None), (2, "short")]))
    assert variants.group_variants(none).count() == 0


def test_words_without_deletions(spark):
    rows = documents(spark, [(i, "abcdefgh " * 5) for i in range(400)])
    got = variants.word_counts(rows, delete_one_in=0).collect()
    assert [(r.word, r.n) for r in got] == [("abcdefgh", 2000)]
