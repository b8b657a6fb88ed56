"""Registered queries: each applies one operator to its whole table."""

from pyspark.sql import functions as F

from vitrine.llm import (
    bfd_packing, chat, collocations, decontaminate, exact_dedup, langid, near_dedup, online_packing, pii, piece_bpe,
    quality, secrets, variants,
)
from vitrine.llm.common import table
from vitrine.sources.shared import new_path


def op1_decontamination(spark, sf_dir):
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark, sf_dir):
    return pii.digest(pii.find_personal_data(table(spark, sf_dir, "documents")))


def op3_token_matrices(spark, sf_dir):
    """Segments of the written matrices, with the checksum of their stored ids."""
    blocks = bfd_packing.write_matrices(table(spark, sf_dir, "documents"), new_path(spark, "matrices"))
    return bfd_packing.segments(blocks).withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"), 5, 0)
    model = langid.train(docs.where(~out).select("lang", "text"))
    return langid.predict(docs, model).withColumn("held_out", out)


def op5_secrets(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op6_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), F.lit(said).alias("prompt"), F.lit(said).alias("response"))
    return chat.digest(chat.format_chats(chat.canonical(rows).unionByName(chat.canonical(more))))


def op7_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = langid.held_out(F.col("doc_id"), 3, 1)
    known = labels.where(~out).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, known)
    return quality.score(docs, model).withColumn("held_out", out)


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op9_online_packing(spark, sf_dir):
    return online_packing.pack_online(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), words=2)


def op11_byte_bpe(spark, sf_dir):
    return piece_bpe.digest(piece_bpe.decode(piece_bpe.encode(table(spark, sf_dir, "documents"))))


def op12_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir):
    return variants.group_variants(variants.word_counts(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_pii, op3_token_matrices, op4_language_id, op5_secrets, op6_chat_format,
    op7_quality, op8_exact_dedup, op9_online_packing, op10_minhash_near_dedup, op11_byte_bpe, op12_collocations,
    op13_spelling_variants,
)}
ORACLES = {
    "op6_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        e AS (
            SELECT *, length(role) + length(text) + 9 + length(regexp_replace(role || text, '[^\\<\[\]]', '', 'g')) AS n
            FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
                   AS loss_sha256,
               CAST(sum(n) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
    "op8_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
            FROM documents)
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
    "op12_collocations": r"""
        WITH p AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (
            SELECT lang, 1 AS k, unnest(ws) AS phrase FROM w
            UNION ALL SELECT lang, 2, unnest([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) FROM w
            UNION ALL SELECT lang, 3, unnest([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FOR i IN range(1, len(ws) - 1)])
            FROM w),
        f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        c AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
        cuts AS (
            SELECT *, array_to_string(ws[1:cut], ' ') AS head, array_to_string(ws[cut + 1:], ' ') AS tail
            FROM c, (VALUES (1), (2)) v(cut) WHERE cut < k),
        scored AS (
            SELECT cuts.lang, cuts.k, cuts.phrase, cuts.a, x.a AS l, y.a AS r, cut,
                   (1000000::HUGEINT * cuts.a * cuts.a) // (x.a::HUGEINT * y.a) AS score
            FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = head JOIN f y ON y.lang = cuts.lang AND y.phrase = tail),
        best AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
        inside AS (
            SELECT lang, part, max(a) AS longer
            FROM (SELECT lang, a, unnest([ws[1] || ' ' || ws[2], ws[2] || ' ' || ws[3]]) AS part FROM c WHERE k = 3)
            GROUP BY ALL),
        left_over AS (
            SELECT best.* FROM best LEFT JOIN inside i ON i.lang = best.lang AND i.part = best.phrase
            WHERE longer IS NULL OR 100 * longer < 50 * a),
        total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
               CAST(score AS BIGINT) AS score
        FROM left_over JOIN total USING (lang)
        QUALIFY rank <= 2000""",
}
