"""Spans of regular expressions in texts, as column expressions."""

from pyspark.sql import Column, functions as F

NO_SPANS = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def gathered(items: Column, add, kind: str, after) -> Column:
    """Walk ``items`` with a position and append to an array<kind> on the way.

    ``add(at, item)`` gives the next position and the array to append, ``after(at, all)``
    the result.  An append copies the array, so blocks of about sqrt(n) items are
    gathered on their own: n * sqrt(n) in all.
    """
    def one(acc, x):
        at, more = add(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], more).alias("out"))

    def block(acc, b):
        begin = F.struct(acc["at"].alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(b, begin, one, lambda r: F.struct(
            r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def walk(held):
        size = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(held))).cast("int"))
        blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(held), F.lit(1)), size), lambda i: F.slice(held, i, size))
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.aggregate(blocks, begin, block, lambda r: after(r["at"], F.flatten(r["out"])))

    # a lambda's argument is computed once
    return F.get(F.transform(F.array(items), walk), F.lit(0))


def matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array<struct<start, end, value, part>>: leftmost non-overlapping matches.

    Positions count code points, the end is exclusive; ``part`` is the ``group`` of the
    match.  The pattern runs twice, once for what lies between the matches; no match
    may be empty.
    """
    regexp = F.lit(pattern)
    found = F.regexp_extract_all(text, regexp, F.lit(0))
    part = F.regexp_extract_all(text, regexp, F.lit(group)) if group else found
    each = F.arrays_zip(
        F.slice(F.transform(F.split(text, pattern, -1), F.length), F.lit(1), F.size(found)).alias("gap"),
        found.alias("value"), part.alias("part"))

    def add(at, x):
        start = at + x["gap"]
        end = start + F.length(x["value"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["part"].alias("part")))

    return gathered(each, add, "struct<start:int,end:int,value:string,part:string>", lambda at, out: out)


def find(text: Column, kinds) -> Column:
    """Sorted spans array<struct<start, rank, kind, end, value>> of all kinds.

    ``kinds``: (name, pattern, group, may(text), valid(match)); ``may`` is a cheap test
    that every text with a match passes, matches that aren't ``valid`` are dropped.
    """
    def own(rank, name, pattern, group, may, valid):
        good = F.filter(matches(text, pattern, group), valid)
        named = F.transform(good, lambda m: F.struct(
            m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(name).alias("kind"),
            m["end"].alias("end"), m["value"].alias("value")))
        return F.when(may(text), named).otherwise(F.array().cast(NO_SPANS))

    return F.array_sort(F.concat(*[own(rank, *kind) for rank, kind in enumerate(kinds)]))


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")


def overlaps(span, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def replaced(text: Column, spans: Column, by) -> Column:
    """``text`` with each span replaced by ``by(span)``; of overlapping spans the first wins."""
    nothing = F.array().cast("array<string>")

    def add(at, s):
        kept = F.substring(text, at + 1, s["start"] - at)
        apart = s["start"] >= at
        return F.when(apart, s["end"]).otherwise(at), F.when(apart, F.array(kept, by(s))).otherwise(nothing)

    return gathered(spans, add, "string", lambda at, out: F.concat(
        F.array_join(out, ""), F.substring(text, at + 1, F.length(text))))
