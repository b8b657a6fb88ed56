"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities.  Terms of the documents that hold an entity are
weighed by how much they reveal it, or the group it is of (a mail domain, a network, the
first digits of a number): their pointwise mutual information over the corpus, as a share
of the entity's own information content.  A term needs evidence: its occurrences beside
the entity must be too many for chance, given all pairs that were examined, and it must
leave few documents open.  Above one threshold a term is generalised, above a second one
removed, wherever it stands in a text with the entity.  Equal texts are one document of
the corpus.
"""

import math

from pyspark.sql import Column, DataFrame, functions as F

from vitrine.llm.common import gather, id_and_text, small_or_shuffled
from vitrine.llm.spans import NO_SPANS, count_of, find, gathered, overlaps, replaced, written
from vitrine.sources.shared import cut_lineage

PRIOR = 1.0       # documents of prior evidence that a term tells nothing of an entity
GENERALISE, REMOVE = 0.6, 0.9
CHANCE = 0.05     # at most this many pairs of the whole corpus pass the test by chance
FREQUENT = 500    # terms of more than one in so many documents are known when pairs are built
LEFT_OPEN = 16.0  # a term that stands in more documents for each one with the entity reveals none

# The patterns of the contract, possessive so that long runs stay linear.
_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"
WORD = r"[\p{L}\p{N}]+"


def _digits(m, signs="[^0-9]"):
    return F.regexp_replace(m["value"], signs, "")


KINDS = (
    ("email", EMAIL, None, lambda t: t.contains("@"), lambda m: F.lit(True)),
    ("ip", IP, None, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m["value"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")),
    ("card", CARD, None, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
     lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m))),
    ("phone", PHONE, None, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(10, 15)),
)


def base_spans(text: Column) -> Column:
    return find(text, KINDS)


def _copy(text: Column) -> Column:
    return F.sha2(text, 256)


def _terms(text: Column) -> Column:
    """The terms of a text, as often as they come: words with a letter."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1)
    return F.filter(words, lambda w: w.rlike(r"\p{L}"))


def _counted(terms: Column) -> Column:
    """array<struct<term, tf>>: the different ``terms`` and how often each comes."""
    def runs(held):
        starts = F.filter(F.transform(held, lambda x, i: F.when((i == 0) | (x != F.get(held, i - 1)), i)), lambda i: i.isNotNull())

        def counted(at):
            return F.transform(at, lambda i, k: F.struct(
                F.get(held, i).alias("term"), (F.coalesce(F.get(at, k + 1), F.size(held)) - i).alias("tf")))

        return F.get(F.transform(F.array(starts), counted), F.lit(0))

    # a lambda's argument is computed once
    return F.get(F.transform(F.array(F.sort_array(terms)), runs), F.lit(0))


def _names(base: Column) -> Column:
    """What is protected: entities as kind:value and their groups as kind~value."""
    def both(s):
        value, number = F.lower(s["value"]), _digits(s)
        group = (F.when(s["kind"] == "email", F.substring_index(value, "@", -1))
                 .when(s["kind"] == "ip", F.substring_index(value, ".", 3))
                 .when(s["kind"] == "phone", F.left(number, F.lit(5))).otherwise(F.left(number, F.lit(6))))
        return F.array(F.concat(s["kind"], F.lit(":"), value), F.concat(s["kind"], F.lit("~"), group))

    return F.array_distinct(F.flatten(F.transform(base, both)))


def _beside(text: Column, base: Column) -> Column:
    """The text with its entities blanked."""
    return replaced(text, base, lambda s: F.lit(" "))


def detect(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, copy, chars, text) of (doc_id, text), written once; text only where an entity stands."""
    found = docs.withColumn("base", base_spans(F.col("text")))
    return cut_lineage(found.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "base", _copy(F.col("text")).alias("copy"), F.length("text").alias("chars"),
        F.when(F.size("base") > 0, F.col("text")).alias("text")))


def _weights(found: DataFrame) -> DataFrame:
    """(copy, weight) of texts that come more than once: each copy is 1 / copies of a document."""
    copies = found.groupBy("copy").agg(F.count("*").alias("c")).where("c > 1")
    return cut_lineage(copies.select("copy", (1 / F.col("c")).alias("weight")))


def _weighted(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """``rows`` with their weight."""
    return rows.join(small_or_shuffled(weights), "copy", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))


def _documents(weight="weight"):
    """Whole documents of summed weights."""
    return F.round(F.sum(weight))


def document_frequency(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(term, n_term): different texts of the corpus that hold each term."""
    rows = _weighted(docs.select("text", _copy(F.col("text")).alias("copy")), weights)
    return rows.select("weight", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(
        _documents().alias("n_term"))


def _pair():
    return F.concat("entity", F.lit("\u0001"), "term").alias("pair")


def _evidence(joint: Column, events: Column, share: Column) -> Column:
    """Chernoff's exponent: ``joint`` or more of ``events`` fall on a part of ``share`` by chance
    with probability exp(-evidence) at most."""
    q = joint / events
    inside = q * F.ln(q / share)
    outside = F.when(q < 1, (1 - q) * F.ln((1 - q) / (1 - share))).otherwise(F.lit(0.0))
    return F.when((q > share) & (share < 1), events * (inside + outside)).otherwise(F.lit(0.0))


def disclosing_terms(docs: DataFrame, found: DataFrame, generalise=GENERALISE, remove=REMOVE, prior=PRIOR) -> DataFrame:
    """(row, terms): for each text the terms that disclose one of its entities, a map to their share.

    Every occurrence beside the entity counts as evidence, elsewhere every document.  The
    entity's part of the corpus is that of its texts' characters.  What a term reveals of
    a group is a share of the information of an entity of one document.

    Pairs that fail whatever their counts are never built: those of an entity in too many
    documents for the share, those whose frequent term leaves too many documents open, and
    of an entity of one document those that are no evidence.
    """
    weights = _weights(found)
    held = _weighted(found.where(F.size("base") > 0), weights)
    near = cut_lineage(held.select("row", "weight", "chars", _names(F.col("base")).alias("entities"),
                                   _counted(_terms(_beside(F.col("text"), F.col("base")))).alias("terms")))
    named = near.select("row", "weight", "chars", F.explode("entities").alias("entity"))
    examined = near.agg(F.sum(F.col("weight") * F.size("entities") * F.size("terms"))).first()[0]
    least = math.log(max(1.0, examined or 1.0) / CHANCE)
    whole = _weighted(found.select("copy", "chars"), weights).agg(
        _documents(), F.sum(F.col("weight") * F.col("chars"))).first()
    n, chars = float(max(1, whole[0] or 1)), float(max(1, whole[1] or 1))
    lowest = min(generalise, remove)

    def share(joint, spread):
        """What a term of ``spread`` documents tells, ``joint`` of them with the entity."""
        base_rate = F.col("n_entity") / n
        given = (joint + prior * base_rate) / (spread + prior)
        own = F.when(F.col("entity").rlike("^[a-z]+~"), F.lit(math.log2(n))).otherwise(-F.log2(base_rate))
        return F.when(own > 0, F.log2(given / base_rate) / own).otherwise(F.lit(0.0))

    entities = named.groupBy("entity").agg(_documents().alias("n_entity"), F.sum(F.col("weight") * F.col("chars")).alias("of_chars"))
    # no term tells more than one of all the entity's documents and no others
    entities = cut_lineage(entities.where(share(F.col("n_entity"), F.col("n_entity")) >= lowest - 1e-9))
    # an entity of one document has no further occurrences: what can't be evidence isn't paired
    bits = F.ln(chars / F.greatest(F.lit(1.0), "of_chars"))
    enough = F.when(F.col("n_entity") == 1, F.try_divide(F.lit(least - 1e-6), bits)).otherwise(F.lit(0.0))
    paired = cut_lineage(gather(named.select("row", "entity"), entities, "entity", spread=("row",)).withColumn("enough", enough))
    frequency = cut_lineage(document_frequency(docs, weights))
    # at most FREQUENT times the mean number of terms of a document
    frequent = F.broadcast(frequency.where(F.col("n_term") > max(3 * LEFT_OPEN, n / FREQUENT)).withColumnRenamed("n_term", "often"))
    each = near.select("row", "weight", "terms").join(small_or_shuffled(paired), "row")
    each = each.select("row", "weight", "entity", "n_entity", "of_chars", "enough", F.inline("terms")).where(F.col("tf") >= F.col("enough"))
    each = each.join(frequent, "term", "left").where(F.coalesce("often", F.lit(0.0)) <= LEFT_OPEN * (F.col("n_entity") + 1))
    pairs = each.groupBy("entity", "term").agg(
        _documents().alias("n_pair"), F.sum(F.col("weight") * F.col("tf")).alias("joint"),
        F.first("n_entity").alias("n_entity"), F.first("of_chars").alias("of_chars"))
    # the evidence if the term stood nowhere else
    pairs = cut_lineage(pairs.where(F.col("joint") * bits >= least - 1e-6))
    wanted = cut_lineage(pairs.select("term").distinct())
    terms = cut_lineage(frequency.join(small_or_shuffled(wanted), "term", "left_semi"))
    weighed = gather(pairs, terms, "term", spread=("entity",))
    # fractions of copies are rounded
    spread = F.greatest("n_term", "n_pair")
    evidence = _evidence(F.col("joint"), F.col("joint") + spread - F.col("n_pair"), F.col("of_chars") / chars)
    weighed = weighed.withColumn("share", share(F.col("n_pair"), spread))
    weighed = weighed.where((F.col("share") >= lowest) & (evidence >= least) & (spread <= LEFT_OPEN * F.col("n_pair")))
    weighed = cut_lineage(weighed.select(_pair(), "share"))
    told = gather(each.select("row", "term", _pair()), weighed, "pair", spread=("row", "term"))
    told = told.groupBy("row", "term").agg(F.max("share").alias("share"))
    return told.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms"))


def _occurrences(text: Column, terms: Column, base: Column, span) -> Column:
    """``span(start, end, share)`` of every occurrence of ``terms`` outside the entities."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    each = F.arrays_zip(F.slice(F.transform(F.split(text, WORD, -1), F.length), F.lit(1), F.size(found)).alias("gap"),
                        found.alias("word"))
    nothing = F.array().cast(NO_SPANS)

    def add(at, x):
        start = at + x["gap"]
        end = start + F.length(x["word"])
        share = F.try_element_at(terms, F.lower(x["word"]))
        told = share.isNotNull() & ~overlaps({"start": start, "end": end}, base)
        return end, F.when(told, F.array(span(start, end, share))).otherwise(nothing)

    return gathered(each, add, "struct<start:int,rank:int,kind:string,end:int,value:string>", lambda at, out: out)


def find_personal_data(docs: DataFrame, id_col="doc_id", text_col="text", generalise=GENERALISE, remove=REMOVE,
                       prior=PRIOR) -> DataFrame:
    """One row per document: doc_id, base, spans.

    ``base`` are the entities' spans, ``spans`` those and the disclosing terms', kind
    ``term_generalised`` or ``term_removed``.  Positions count code points.  A null text
    is empty; null ids and repeated rows are kept (equal texts are one document of the
    corpus); extra columns are ignored; an empty table gives no rows.
    """
    docs = id_and_text(docs, id_col, text_col)
    found = detect(docs)
    terms = disclosing_terms(docs, found, generalise, remove, prior)

    def span(start, end, share):
        kind = F.when(share >= remove, F.lit("term_removed")).otherwise(F.lit("term_generalised"))
        return F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), kind.alias("kind"), end.alias("end"), F.lit("").alias("value"))

    joined = found.select("row", "doc_id", "base", "text").join(terms, "row", "left")
    more = _occurrences(F.col("text"), F.col("terms"), F.col("base"), span)
    spans = F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", more)))
    return joined.select("doc_id", "base", spans.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text without what ``spans`` name: entities become their kind, disclosing terms
    a placeholder or nothing."""
    return replaced(text, spans, lambda s: F.when(s["kind"] == "term_removed", F.lit("")).when(
        s["kind"] == "term_generalised", F.lit("[TERM]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))


def digest(found: DataFrame) -> DataFrame:
    """The spans as counts, a checksum and a string."""
    return found.select(
        "doc_id", *[count_of(F.col("base"), k[0]).alias(f"n_{k[0]}") for k in KINDS],
        F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
