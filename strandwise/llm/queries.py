"""Queries of the language-model operators over whole tables, and SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.llm.common import table


def op1_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.quality import learned, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learned(docs, table(spark, sf_dir, "labels")), threshold=0.7)


def op2_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.html_template import extract

    return extract(table(spark, sf_dir, "pages"))


def op3_threshold_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


def op4_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.pii import find

    return find(table(spark, sf_dir, "documents"))


def op5_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.toxicity import learned, score_documents

    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, learned(docs, table(spark, sf_dir, "labels")), threshold=0.3)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.token_file import read_tokens, write_tokens

    manifest = write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return read_tokens(manifest)


def op7_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.common import MANY
    from strandwise.llm.packing import pack, pieces

    cut = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, size=1024, remembered=MANY)
    return pack(cut, 1024).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.ngram_join import classes_of

    return classes_of(table(spark, sf_dir, "documents"))


def op9_rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.bpe import encode_and_decode

    return encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.fingerprint import fingerprints

    return fingerprints(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=512)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.collocations import collocations

    return collocations(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandwise.llm.conversations import repair

    return repair(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_byte_cnn_quality": op1_byte_cnn_quality,
    "op2_template_extraction": op2_template_extraction,
    "op3_threshold_top_k": op3_threshold_top_k,
    "op4_semi_markov_pii": op4_semi_markov_pii,
    "op5_recurrent_toxicity": op5_recurrent_toxicity,
    "op6_token_files": op6_token_files,
    "op7_minimum_bin_slack": op7_minimum_bin_slack,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_rank_queue_bpe": op9_rank_queue_bpe,
    "op10_fingerprints": op10_fingerprints,
    "op11_token_counts": op11_token_counts,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_conversation_repair": op13_conversation_repair,
}


def plus(state: str, cost: int | str, edits: str) -> str:
    """SQL: a state of eight digits of cost and an audit, with a cost and edits added."""
    return f"lpad(CAST(CAST(left({state}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9) || '{edits}'"


ORACLE_SQL: dict[str, str] = {
    "op3_threshold_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_phrase_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
            FROM documents
        ), worded AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces
        ), grams AS (
            SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) AS phrase
            FROM worded, range(1, 6) AS sizes(k)
            WHERE len(w) >= k
        ), f AS (
            SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
        ), candidates AS (
            SELECT lang, k, phrase, f FROM f WHERE k > 1 AND f >= 100
        ), inside AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[b : b + m - 1], ' ') AS part, max(f) AS f
            FROM candidates, range(2, 5) AS sizes(m), range(1, 5) AS begins(b)
            WHERE m < k AND b + m - 1 <= k
            GROUP BY lang, part
        ), kept AS (
            SELECT c.lang, c.k, c.phrase, c.f AS a
            FROM candidates c LEFT JOIN inside i ON i.lang = c.lang AND i.part = c.phrase AND 100 * i.f >= 100 * c.f
            WHERE i.part IS NULL
        ), cut AS (
            SELECT lang, phrase, a, c, array_to_string(string_split(phrase, ' ')[1 : c], ' ') AS head, array_to_string(string_split(phrase, ' ')[c + 1 : k], ' ') AS tail
            FROM kept, range(1, 5) AS cuts(c)
            WHERE c < k
        ), scored AS (
            SELECT cut.lang, cut.phrase, a, c, x.f AS l, y.f AS r, n, CAST(1000 * CAST(a AS HUGEINT) * n // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
            FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail JOIN totals ON totals.lang = cut.lang
        ), lowest AS (
            SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1
        ), ranked AS (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
    """,
    # A state is its cost in eight digits and its audit, so the least string is the cheapest audit, the first of equal ones.
    "op13_conversation_repair": rf"""
        WITH RECURSIVE named AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
            FROM conversations
        ), kinds AS (
            SELECT *, xor(list_reduce(
                list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, bit: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
            ), 4294967295) % 20 AS kind
            FROM named
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, copy
            FROM kinds, range(2) AS copies(copy)
            WHERE kind <> 0 AND (copy = 0 OR kind = 3)
        ), convs AS (
            SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
        ), placed AS (
            SELECT c, turn, role, text, left(role, 1) AS initial, rtrim(text, E' \t\n\x0B\f\r') AS visible,
                   row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || ':' || text), copy) AS i
            FROM damaged d JOIN convs ON convs.conv_id IS NOT DISTINCT FROM d.conv_id
        ), seen AS (
            SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS neighbours FROM placed
        ), facts AS (
            SELECT c, i, turn, role, text, initial, neighbours, visible = '' AS blank, visible <> '' AND again AS duplicate,
                   visible <> '' AND NOT again AND right(visible, 1) NOT IN ('.', '!', '?') AS truncated, visible = '' OR again AS go
            FROM seen
        ), steps AS (
            SELECT c, CAST(0 AS BIGINT) AS i, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, '00000002I' AS s2, '00000004II' AS s3 FROM convs
            UNION ALL
            SELECT c, i, r0, r1, least(r2, {plus('r0', 2, 'I')}, {plus('r1', 2, 'I')}, {plus('r3', 2, 'I')}), least(r3, {plus('r2', 2, 'I')}, {plus('r0', 4, 'II')}, {plus('r1', 4, 'II')})
            FROM (
                SELECT c, i, {plus('s0', '3', 'D')} AS r0, least({plus('s1', '3', 'D')}, CASE WHEN initial = 's' AND NOT go THEN {plus('s0', 'cut', 'K')} END) AS r1,
                       least({plus('s2', '3', 'D')}, CASE WHEN initial = 'u' AND NOT go THEN least({plus('s0', 'cut', 'K')}, {plus('s1', 'cut', 'K')}, {plus('s3', 'cut', 'K')}) END, CASE WHEN NOT go THEN least({plus('s0', '2 + cut', 'R')}, {plus('s1', '2 + cut', 'R')}, {plus('s3', '2 + cut', 'R')}) END) AS r2,
                       least({plus('s3', '3', 'D')}, CASE WHEN initial = 'a' AND NOT go THEN {plus('s2', 'cut', 'K')} END, CASE WHEN NOT go THEN {plus('s2', '2 + cut', 'R')} END) AS r3
                FROM (
                    SELECT steps.c, facts.i, initial, go, CAST(truncated AS BIGINT) AS cut, s0, s1, s2, s3
                    FROM steps JOIN facts ON facts.c = steps.c AND facts.i = steps.i + 1
                )
            )
        ), ended AS (
            SELECT c, least(s0, s3) AS best FROM steps QUALIFY row_number() OVER (PARTITION BY c ORDER BY i DESC) = 1
        ), audits AS (
            SELECT c, CAST(left(best, 8) AS BIGINT) AS cost, substr(best, 9) AS audit FROM ended
        ), edits AS (
            SELECT c, j, audit[j] AS edit, length(replace(left(audit, j), 'I', '')) AS i, length(replace(left(audit, j), 'D', '')) AS p
            FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS j FROM audits)
        ), left_rows AS (
            SELECT e.c, p, edit, f.role, f.text, bool_or(p = 1 AND edit = 'K' AND f.initial = 's') OVER (PARTITION BY e.c) AS led
            FROM edits e LEFT JOIN facts f ON f.c = e.c AND f.i = e.i
            WHERE edit <> 'D'
        ), mended AS (
            SELECT c, string_agg(CASE edit
                WHEN 'K' THEN role || ':' || text
                ELSE CASE WHEN (p - CAST(led AS BIGINT)) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END
            END, chr(10) ORDER BY p) AS text
            FROM left_rows GROUP BY c
        ), sums AS (
            SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
                   count_if(truncated) AS truncated, count_if(neighbours IS NOT NULL AND neighbours NOT IN ('su', 'ua', 'au')) AS illegal
            FROM facts GROUP BY c
        )
        SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, cost, audit, sha256(coalesce(mended.text, '')) AS repaired_sha256
        FROM convs JOIN audits USING (c) LEFT JOIN sums USING (c) LEFT JOIN mended USING (c)
    """,
}
