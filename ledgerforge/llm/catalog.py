"""Registered queries of the text operators, over the whole tables they are meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .bpe_codec import bpe_round_trip
from .chat_format import chat_digests
from .common import read_table
from .language_id import language_id
from .line_dedup import line_classes
from .ngram_join import ngram_components
from .packing import packed_documents
from .phrase_mining import collocations
from .sorted_tables import token_tables
from .span_hashes import span_fingerprints
from .token_counts import token_counts
from .toxicity import toxicity
from .transport_streams import media_columns
from .turn_repair import repair_report

WORD_VOCABULARY = "word_bpe_49k.json"
BYTE_VOCABULARY = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(read_table(spark, sf_dir, "documents"))


def op1_line_dedup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for every line, short ones too, as the pipeline needs it."""
    return line_classes(read_table(spark, sf_dir, "documents"), least=0)


def op2_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(read_table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read_table(spark, sf_dir, "documents"))


def op6_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(read_table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_VOCABULARY))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op10_span_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_fingerprints(read_table(spark, sf_dir, "documents"))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_digests(read_table(spark, sf_dir, "conversations"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_report(read_table(spark, sf_dir, "conversations"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op1_line_dedup_all": op1_line_dedup_all,
    "op2_transport_streams": op2_transport_streams,
    "op3_ngram_join": op3_ngram_join,
    "op4_token_counts": op4_token_counts,
    "op5_language_id": op5_language_id,
    "op6_sorted_tables": op6_sorted_tables,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_toxicity": op8_toxicity,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_span_hashes": op10_span_hashes,
    "op11_chat_formatting": op11_chat_formatting,
    "op12_turn_repair": op12_turn_repair,
    "op13_phrase_mining": op13_phrase_mining,
}
#: DuckDB counts edits in bytes; these letters of the data get one byte each there.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
MARKS = "".join(chr(c) for c in (*range(1, 9), *range(14, 32)))[: len(LETTERS)]

#: The other operators have no SQL form; `tests/llm` holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": """
        WITH RECURSIVE
        places AS (
            SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_no, unnest(parts) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
        ),
        long AS (SELECT * FROM places WHERE length(line) >= 20),
        different AS (
            SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id,
                   translate(line, '{letters}', '{marks}') AS one_byte
            FROM (SELECT DISTINCT line FROM long)
        ),
        links AS MATERIALIZED (
            SELECT a.id AS a, b.id AS b
            FROM different a JOIN different b
              ON b.n BETWEEN a.n AND a.n + 2 AND (a.n < b.n OR a.id < b.id)
             AND levenshtein(a.one_byte, b.one_byte) <= 2
        ),
        both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
        reach AS (
            SELECT a AS id, a AS seen FROM both_ways
            UNION
            SELECT r.id, w.b FROM reach r JOIN both_ways w ON w.a = r.seen
        ),
        classes AS (
            SELECT d.line, coalesce(r.c, d.id) AS class, coalesce(g.n_links, 0) AS n_links
            FROM different d
            LEFT JOIN (SELECT id, min(seen) AS c FROM reach GROUP BY id) r USING (id)
            LEFT JOIN (SELECT a AS id, count(*) AS n_links FROM both_ways GROUP BY a) g USING (id)
        ),
        placed AS (SELECT l.doc_id, l.line_no, length(l.line) AS n_chars, c.class, c.n_links FROM long l JOIN classes c USING (line)),
        firsts AS (SELECT class, min((doc_id, line_no)) AS f FROM placed GROUP BY class)
        SELECT doc_id, line_no, CAST(n_chars AS INTEGER) AS n_chars, f[1] AS class_doc_id, f[2] AS class_line_no,
               CAST(n_links AS BIGINT) AS n_links, (doc_id = f[1] AND line_no = f[2]) AS kept
        FROM placed JOIN firsts USING (class)
    """.replace("{letters}", LETTERS).replace("{marks}", MARKS),
}
#: The same over every line; lines below 20 characters allow one edit, those below 10 none.
ORACLE_SQL["op1_line_dedup_all"] = (
    ORACLE_SQL["op1_line_dedup"]
    .replace("WHERE length(line) >= 20", "")
    .replace("levenshtein(a.one_byte, b.one_byte) <= 2", "levenshtein(a.one_byte, b.one_byte) <= CASE WHEN a.n >= 20 THEN 2 WHEN a.n >= 10 THEN 1 ELSE 0 END")
)

ORACLE_SQL["op11_chat_formatting"] = r"""
    WITH
    told AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL
        SELECT -7, k, ['user', 'assistant'][k + 1], '\### Assistant: </turn> ok' FROM range(2) AS r(k)
    ),
    sized AS (
        SELECT *, row_number() OVER whole AS k, count(*) OVER (PARTITION BY conv_id) AS n,
               15 + length(replace(replace(replace(replace(role, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn'), '>', '\g'))
                  + length(replace(replace(replace(text, '\', '\b'), '<turn', '\lturn'), '</turn', '\l/turn')) AS size
        FROM told WINDOW whole AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
    ),
    summed AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM sized)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars,
           count(*) FILTER (WHERE role = 'assistant' OR k = n) AS n_examples
    FROM summed GROUP BY conv_id
"""


def _repair_sql() -> str:
    """A plain recursion over turns: each state keeps its least (cost, edits) as one text."""

    def more(value: str, cost: str, edit: str) -> str:
        return f"(printf('%012d', CAST(substr({value}, 1, 12) AS BIGINT) + {cost}) || substr({value}, 13) || '{edit}')"

    def kept(value: str, role: str) -> str:
        return f"CASE WHEN initial = '{role}' THEN {more(value, 'late', 'K')} END"

    late = "2 + late"
    users = ", ".join(f"{kept(v, 'u')}, {more(v, late, 'R')}" for v in ("st", "sy", "d1"))
    return f"""
        WITH RECURSIVE
        byte_sums AS (
            SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) AS sums
        ),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(
                       list_concat([4294967295], list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(unicode(c) AS BIGINT))),
                       lambda c, b: xor(c >> 8, sums[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
            FROM conversations, byte_sums
        ),
        damaged AS (
            SELECT conv_id, turn, unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM keyed WHERE fault <> 0
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
                   regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body
            FROM damaged
        ),
        judged AS (
            SELECT conv_id, turn, k, role, text, substr(role, 1, 1) AS initial, body = '' AS blank, body <> '' AND nth > 1 AS duplicate,
                   body <> '' AND nth = 1 AND substr(body, length(body), 1) NOT IN ('.', '!', '?') AS truncated,
                   lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before
            FROM placed
        ),
        sums AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate,
                   count_if(truncated) AS truncated, count_if(before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(k) AS n
            FROM judged GROUP BY conv_id
        ),
        walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS k, '000000000000' AS st, CAST(NULL AS VARCHAR) AS sy, CAST(NULL AS VARCHAR) AS us, CAST(NULL AS VARCHAR) AS dn
            FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, k, {more("st", "3", "D")},
                   CASE WHEN goes THEN {more("sy", "3", "D")} ELSE least({more("sy", "3", "D")}, {kept("st", "s")}) END,
                   CASE WHEN goes THEN {more("u1", "3", "D")} ELSE least({more("u1", "3", "D")}, {users}) END,
                   CASE WHEN goes THEN {more("d1", "3", "D")} ELSE least({more("d1", "3", "D")}, {kept("u1", "a")}, {more("u1", late, "R")}) END
            FROM (
                SELECT *, least(dn, {more("u1", "2", "I")}) AS d1 FROM (
                    SELECT w.conv_id, j.k, st, sy, least(us, {more("st", "2", "I")}, {more("sy", "2", "I")}, {more("dn", "2", "I")}) AS u1, dn,
                           j.blank OR j.duplicate AS goes, CAST(j.truncated AS BIGINT) AS late, j.initial
                    FROM walk w JOIN judged j ON j.conv_id = w.conv_id AND j.k = w.k + 1
                )
            )
        ),
        ended AS (
            SELECT w.conv_id, s.* EXCLUDE (conv_id, n), least(st, dn, {more("us", "2", "I")}) AS best
            FROM walk w LEFT JOIN sums s USING (conv_id) WHERE w.k = coalesce(s.n, 0)
        ),
        steps AS (
            SELECT conv_id, edit, i, sum(CASE WHEN edit <> 'I' THEN 1 ELSE 0 END) OVER upto AS k, sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER upto AS nth,
                   sum(CASE WHEN edit <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS stay
            FROM (SELECT conv_id, generate_subscripts(string_split(substr(best, 13), ''), 1) AS i, unnest(string_split(substr(best, 13), '')) AS edit FROM ended WHERE length(best) > 12)
            WINDOW upto AS (PARTITION BY conv_id ORDER BY i)
        ),
        repaired AS (
            SELECT s.conv_id, s.i, CASE WHEN edit = 'K' THEN j.role WHEN (nth - stay % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE j.text END AS line
            FROM steps s LEFT JOIN judged j ON j.conv_id = s.conv_id AND j.k = s.k AND edit <> 'I' WHERE edit <> 'D'
        ),
        texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM repaired GROUP BY conv_id)
        SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               CAST(substr(best, 1, 12) AS BIGINT) AS cost, substr(best, 13) AS audit, sha256(coalesce(text, '')) AS repaired_sha256, coalesce(n, 0) AS n_repaired
        FROM ended LEFT JOIN texts USING (conv_id)
    """


ORACLE_SQL["op12_turn_repair"] = _repair_sql()

ORACLE_SQL["op13_phrase_mining"] = r"""
    WITH
    pieces AS (
        SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents
    ),
    listed AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]'), lambda w: w <> '') AS ws FROM pieces),
    placed AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM listed),
    grams AS (
        SELECT lang, 1 AS len, ws[i] AS phrase FROM placed
        UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM placed WHERE i + 1 <= len(ws)
        UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM placed WHERE i + 2 <= len(ws)
    ),
    f AS MATERIALIZED (SELECT lang, len, phrase, count(*) AS a FROM grams GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE len = 1 GROUP BY lang),
    cuts AS (
        SELECT lang, len, phrase, a, k, list_aggregate(string_split(phrase, ' ')[:k], 'string_agg', ' ') AS head, list_aggregate(string_split(phrase, ' ')[k + 1:], 'string_agg', ' ') AS rest
        FROM f, range(1, 3) AS cut(k) WHERE len > 1 AND a >= 10 AND k < len
    ),
    scored AS (
        SELECT c.*, h.a AS l, t.a AS r, CAST(1000000 * CAST(c.a AS HUGEINT) * c.a // (CAST(h.a AS HUGEINT) * t.a) AS BIGINT) AS score
        FROM cuts c JOIN f h ON h.lang = c.lang AND h.phrase = c.head JOIN f t ON t.lang = c.lang AND t.phrase = c.rest
    ),
    lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    inside AS (
        SELECT lang, unnest([string_split(phrase, ' ')[1] || ' ' || string_split(phrase, ' ')[2], string_split(phrase, ' ')[2] || ' ' || string_split(phrase, ' ')[3]]) AS phrase, a
        FROM f WHERE len = 3 AND a >= 10
    ),
    longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY ALL),
    ranked AS (
        SELECT w.*, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank
        FROM lowest w LEFT JOIN longer g ON g.lang = w.lang AND g.phrase = w.phrase WHERE g.a IS NULL OR 100 * g.a < 50 * w.a
    )
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
