"""The registered queries of this subpackage and the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import compression, html_tree, toxicity
from marketloom.llm.bpe import round_trip_digests
from marketloom.llm.chat import perspectives
from marketloom.llm.exact_dedup import exact_dedup
from marketloom.llm.packing import best_fit_packing
from marketloom.llm.pii import pii_report
from marketloom.llm.prefix_trie import COLUMNS as TRIE_COLUMNS
from marketloom.llm.prefix_trie import conversation_trie
from marketloom.llm.quality import quality
from marketloom.llm.simhash import near_duplicates
from marketloom.llm.spelling import spelling_variants
from marketloom.llm.token_files import token_files


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_chat_perspectives(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return perspectives(table(spark, folder, "conversations")).withColumn("mask", spans)


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(table(spark, folder, "documents"))


def op4_quality_llr(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality(table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup(table(spark, folder, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op6_pii_disclosure(spark: SparkSession, folder: str) -> DataFrame:
    return pii_report(table(spark, folder, "documents"))


def op7_toxic_segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.toxicity_scores(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return best_fit_packing(table(spark, folder, "documents"))


def op9_html_tree_model(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return html_tree.main_texts(pages, html_tree.fit(pages))


def op10_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files(table(spark, folder, "documents"))


def op11_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations")).select(*TRIE_COLUMNS)


def op12_compression_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return compression.quality_scores(docs, compression.fit(docs, table(spark, folder, "labels")))


def op13_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_variants(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_perspectives,
        op2_simhash_near_dedup,
        op3_byte_bpe,
        op4_quality_llr,
        op5_exact_dedup,
        op6_pii_disclosure,
        op7_toxic_segments,
        op8_best_fit_packing,
        op9_html_tree_model,
        op10_token_files,
        op11_conversation_trie,
        op12_compression_quality,
        op13_spelling_variants,
    )
}

#: The table of the unsigned crc32, and its value over a list of bytes.
CRC_TABLE = """
        crc AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 1, 2, 3, 4, 5, 6, 7, 8],
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab
        )"""


def crc_sql(data: str, tab: str = "tab") -> str:
    step = f"lambda c, b: xor(c >> 8, {tab}[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {data}), {step}), 4294967295)"


SQL = {
    "op1_chat_perspectives": r"""
        WITH said AS (
            SELECT DISTINCT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
                   coalesce(CAST(floor(turn / 64.0) AS BIGINT), -1) AS part
            FROM conversations
        ),
        speakers AS (SELECT DISTINCT conv_id AS of, role AS speaker FROM said WHERE role <> 'system'),
        pieces AS (
            SELECT conv_id, speaker, part, turn, role, text, role = speaker AS own,
                   '<|' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END
                       || '|>' || chr(10) AS head,
                   text || '<|end|>' || chr(10) AS body
            FROM said JOIN speakers ON conv_id IS NOT DISTINCT FROM of
        ),
        placed AS (
            SELECT *, sum(length(head) + length(body)) OVER (
                PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role, text) AS stop
            FROM pieces
        )
        SELECT conv_id, speaker, part, count(*) AS n_turns,
               string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
               coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY stop) FILTER (WHERE own), '') AS mask,
               CAST(coalesce(sum(length(body)) FILTER (WHERE own), 0) AS BIGINT) AS masked_chars
        FROM placed GROUP BY conv_id, speaker, part""",
    "op5_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept,
               text_sha256
        FROM t""",
    "op11_conversation_trie": rf"""
        WITH {CRC_TABLE},
        own AS (
            SELECT conv_id, list({{'key': sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 'chars': length(coalesce(text, ''))}}
                                 ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
            FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
        ),
        counted AS (
            SELECT conv_id, turns, {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h
            FROM own, crc
        ),
        rebuilt AS (
            SELECT c.conv_id, list_concat(coalesce(f.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
            FROM counted AS c LEFT JOIN own AS f ON f.conv_id = c.conv_id - c.conv_id % 100
        ),
        prefixes AS (
            SELECT conv_id, len(turns) AS size, d, array_to_string(list_transform(turns[1:d], lambda t: t.key), ',') AS path,
                   array_to_string(list_transform(turns[1:d - 1], lambda t: t.key), ',') AS above, coalesce(turns[d].chars, 0) AS chars
            FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM rebuilt)
        ),
        nodes AS (
            SELECT d, path, min(above) AS above, min(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs,
                   sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
            FROM prefixes GROUP BY d, path
        ),
        kids AS (SELECT d - 1 AS d, above AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
        figures AS (
            SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
            FROM nodes AS n LEFT JOIN kids USING (d, path)
        ),
        lines AS (SELECT DISTINCT l.d, l.path, u.d AS top_d, u.path AS top FROM prefixes AS l JOIN prefixes AS u ON l.conv_id = u.conv_id AND u.d <= l.d),
        below AS (
            SELECT top_d AS d, top AS path, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
            FROM lines JOIN figures USING (d, path) GROUP BY top_d, top
        )
        SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
               CAST(saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
        FROM figures AS f JOIN below USING (d, path) LEFT JOIN figures AS p ON f.d > 0 AND p.d = f.d - 1 AND p.path = f.above""",
    "op13_spelling_variants": rf"""
        WITH RECURSIVE {CRC_TABLE},
        runs AS (
            SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
            FROM documents
        ),
        counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY doc_id, run),
        hashed AS (
            SELECT run, n, {crc_sql("""flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''), lambda ch: CASE WHEN unicode(ch) < 128
                THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + (unicode(ch) >> 6) AS BIGINT), CAST(128 + (unicode(ch) & 63) AS BIGINT)] END))""")} AS h
            FROM counted, crc
        ),
        spelt AS (
            SELECT CASE WHEN h % 97 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
            FROM hashed
        ),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
        holes AS (
            SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
        ),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n FROM holes AS a JOIN holes AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT h.word, w.word, w.n FROM holes AS h JOIN words AS w ON h.rest = w.word
            UNION SELECT w.word, h.word, h.n FROM holes AS h JOIN words AS w ON h.rest = w.word
        ),
        best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word),
        formed AS (
            SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * n THEN other END AS form, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
            FROM words AS w LEFT JOIN best AS b ON b.word = w.word
        ),
        follow AS (
            SELECT word, word AS last FROM formed
            UNION ALL SELECT f.word, g.form FROM follow AS f JOIN formed AS g ON g.word = f.last WHERE g.form IS NOT NULL
        )
        SELECT f.word, form, last AS root, n, n_near, form_n
        FROM formed AS f JOIN follow AS r ON r.word = f.word
        WHERE last IN (SELECT word FROM formed WHERE form IS NULL)""",
}
