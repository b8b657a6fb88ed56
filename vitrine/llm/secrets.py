"""Secret scan: fixed patterns, and strings of high entropy.

Candidate strings are runs of key-like characters, and the parts between their
separators.  A window slides over each; the counts of its characters, and from them
Shannon's entropy, are updated by the character that enters and the one that leaves.
Every character class has a threshold of its own.  Strings on the allow-list are
suppressed.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.functions.vectors import let
from vitrine.llm.common import id_and_text
from vitrine.llm.spans import NO_SPANS, count_of, find, gathered, matches, overlaps, written

WINDOW = 16
MIN_LENGTH = WINDOW
_KEY, _SIGN = "[A-Za-z0-9+/_=-]", "+/_=-"
# strings of one case or of digits only are of no class, parts are of none without a digit
_PLAIN = "".join(f"(?![{c}{_SIGN}]++(?!{_KEY}))" for c in ("a-z", "A-Z", "0-9"))
CANDIDATE = rf"(?<!{_KEY}){_PLAIN}{_KEY}{{{MIN_LENGTH},}}+"
PART = rf"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{MIN_LENGTH},}}+"
HEX = "0123456789abcdef"
MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Character classes, no string is of two: name, whether it is one of parts, test of the
#: whole string, alphabet, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", True, r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+$", HEX, 2.8),
    ("entropy_mixed", False, r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", MIXED, 3.2),
    ("entropy_upper_hex", True, r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+$", HEX.upper(), 2.8),
    ("entropy_lower", True, r"^(?=.*[0-9])(?=.*[g-z])[0-9a-z]+$", MIXED[26:62], 3.2),
    ("entropy_upper", True, r"^(?=.*[0-9])(?=.*[G-Z])[0-9A-Z]+$", MIXED[:26] + MIXED[52:62], 3.1),
    ("entropy_letters", False, r"^(?=.*[a-z])(?=.*[A-Z])[^0-9]+$", MIXED, 3.4),
)
_INNER = "(?:[A-Z][a-z]{2,}+|To|Of|In|By|Is|On|At|As|Or|If|No|Up|Id)[0-9]{0,4}+"  # a word of camel case
_WORD = f"(?:[A-Z]?[a-z]++[0-9]{{0,4}}+(?:{_INNER})*+|[A-Z]{{1,5}}+[0-9]{{0,4}}+|[0-9]{{1,4}}+)"
#: Strings that match one of these are no secrets.
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|xxxx",
    rf"^[-_/=]*{_WORD}(?:[-_/]+{_WORD})*+[-_/=]*[0-9]{{0,4}}$",  # words and short numbers
    r"^[A-Z]+(?:[-_/][A-Z]+)*[-_/]?[0-9]{1,4}$",
)

# The patterns of the contract; `drop failing matches` is done by `valid`.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)"""
KINDS = (
    ("assign", ASSIGN, 2, lambda t: t.contains("=") | t.contains(":"), lambda m: F.length(m["part"]) >= 8),
    ("access", "AKIA[A-Z0-9]{12,}+", None, lambda t: t.contains("AKIA"), lambda m: F.lit(True)),
    ("hex", "(?<![0-9a-f])[0-9a-f]{32,}+", None, lambda t: t.rlike("(?<![0-9a-f])[0-9a-f]{32}"), lambda m: F.lit(True)),
)


def _weight(c):
    """c * log2(c), 0 for 0."""
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def hot_range(value: Column, alphabet: str, least: float, window=WINDOW) -> Column:
    """struct<lo, hi>: from the first to the last window of ``value`` with ``least`` bits; lo -1 if none.

    The state holds the counts and S, the sum of c * log2(c) over them: a window's
    entropy is log2(window) - S / window.
    """
    n = F.length(value)
    at = F.transform(F.sequence(F.lit(1), n), lambda i: F.instr(F.lit(alphabet), F.substring(value, i, F.lit(1))) - 1)
    # the leaving character at each step, -1 while the window fills
    left = F.concat(F.array_repeat(F.lit(-1), window), F.slice(at, F.lit(1), F.greatest(n - window, F.lit(0))))
    steps = F.arrays_zip(at.alias("into"), F.slice(left, F.lit(1), n).alias("out"))
    begin = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("s"),
                     F.lit(0).alias("i"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"))

    def slide(acc, x):
        out_count = F.when(x["out"] >= 0, F.get(acc["counts"], F.greatest(x["out"], F.lit(0)))).otherwise(F.lit(0))
        s = acc["s"] - F.when(x["out"] >= 0, _weight(out_count) - _weight(out_count - 1)).otherwise(F.lit(0.0))
        in_count = F.get(acc["counts"], x["into"]) - F.when(x["out"] == x["into"], F.lit(1)).otherwise(F.lit(0))
        s = s + _weight(in_count + 1) - _weight(in_count)
        counts = F.transform(acc["counts"], lambda c, k: c + (k == x["into"]).cast("int") - (k == x["out"]).cast("int"))
        i = acc["i"] + 1
        hot = (i >= window) & (F.lit(math.log2(window)) - s / window >= least)
        return F.struct(counts.alias("counts"), s.alias("s"), i.alias("i"),
                        F.when(hot & (acc["lo"] < 0), i - window).otherwise(acc["lo"]).alias("lo"),
                        F.when(hot, i).otherwise(acc["hi"]).alias("hi"))

    return F.aggregate(steps, begin, slide, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _blanked(text: Column, spans: Column) -> Column:
    """``text`` with spaces where ``spans`` (sorted by their start) stand."""
    nothing = F.array().cast("array<string>")

    def add(at, s):
        start = F.greatest(at, s["start"])
        kept = F.substring(text, at + 1, start - at)
        more = F.array(kept, F.repeat(F.lit(" "), s["end"] - start))
        return F.greatest(at, s["end"]), F.when(s["end"] > at, more).otherwise(nothing)

    return gathered(spans, add, "string", lambda at, out: F.concat(
        F.array_join(out, ""), F.substring(text, at + 1, F.length(text))))


def _parts_with(text: Column, pattern: str) -> Column:
    """The parts between separators in which ``pattern`` begins."""
    found = matches(text, rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9]*?(?:{pattern}))[A-Za-z0-9]++")
    part = F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), part).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def _candidate_spans(text: Column, base: Column, allowed) -> Column:
    """Base spans and allowed parts are cut out of the text, what is left of a candidate is
    scanned.  Patterns of ``allowed`` that begin with ^ are tested on whole strings."""
    whole = [p for p in allowed if p.startswith("^")]
    cut = [_parts_with(text, p) for p in allowed if not p.startswith("^")]
    ends = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    def fine(m):
        bad = F.lit(False)
        for pattern in whole:
            bad = bad | m["value"].rlike(pattern)
        return ~bad

    def of_class(found, rank, name, test, alphabet, least):
        own = F.filter(found, lambda m: m["value"].rlike(test))
        hot = F.transform(own, lambda m: F.struct(m["start"].alias("at"), hot_range(m["value"], alphabet, least).alias("r")))
        return F.transform(F.filter(hot, lambda h: h["r"]["lo"] >= 0), lambda h: F.struct(
            (h["at"] + h["r"]["lo"]).alias("start"), F.lit(len(KINDS) + rank).alias("rank"), F.lit(name).alias("kind"),
            (h["at"] + h["r"]["hi"]).alias("end"), F.lit("").alias("value")))

    def spans(rest, pattern, of_parts):
        return let(F.filter(matches(rest, pattern), fine), lambda found: F.concat(*[
            of_class(found, rank, name, *more) for rank, (name, part, *more) in enumerate(CLASSES) if part == of_parts]))

    def both(rest):
        of_whole = F.struct(spans(rest, CANDIDATE, False).alias("a"), spans(rest, PART, True).alias("b"))
        # a part that the span of its whole string touches is told already
        return let(of_whole, lambda x: F.concat(x["a"], F.filter(x["b"], lambda s: ~overlaps(s, x["a"]))))

    rest = _blanked(text, F.array_sort(F.concat(ends, *cut)))
    return F.when(text.rlike(CANDIDATE), let(rest, both)).otherwise(F.array().cast(NO_SPANS))


def find_secrets(docs: DataFrame, id_col="doc_id", text_col="text", allowed=ALLOWED) -> DataFrame:
    """One row per document: doc_id, text, base, spans (base and entropy spans).

    Positions count code points.  A null text is empty; null ids and repeated rows are
    kept, extra columns ignored; an empty table gives no rows.  Nothing is shuffled.
    """
    docs = id_and_text(docs, id_col, text_col).withColumn("base", find(F.col("text"), KINDS))
    more = _candidate_spans(F.col("text"), F.col("base"), allowed)
    return docs.withColumn("spans", F.array_sort(F.concat("base", more)))


def digest(found: DataFrame) -> DataFrame:
    """The spans as counts, a checksum and a string."""
    return found.select(
        "doc_id", *[count_of(F.col("base"), k[0]).alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
