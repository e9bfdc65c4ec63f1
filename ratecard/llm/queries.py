"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (bpe, conversation_repair, exact_dedup, filter_audit, html_extract, near_dedup, packing, quality,
               secrets, sharding, topk_search, toxicity, warc_zip)
from .common import table


def op1_minhash_tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op2_shard_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


def op4_pack_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_50k.json"), bpe.DIGEST)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_digest(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(table(spark, sf_dir, "documents"))


def op10_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"))


def op11_quality_fourier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_conversation_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_minhash_tensor, op2_shard_propagation, op3_warc_zip, op4_pack_histogram, op5_main_text, op6_bpe_tree,
    op7_toxicity, op8_secret_scan, op9_exact_dedup, op10_topk_threshold, op11_quality_fourier,
    op12_conversation_grammar, op13_filter_audit)}


def _plus(entry: str, cost: str, edits: str) -> str:
    """SQL: an entry (nine digits of cost, then the audit) with more cost and edits; null stays null."""
    return (f"(lpad(CAST(CAST(substr({entry}, 1, 9) AS BIGINT) + {cost} AS VARCHAR), 9, '0') "
            f"|| substr({entry}, 10) || '{edits}')")


def _reads(role: str, states: str) -> str:
    """SQL: the entries that a row taken as ``role`` gives from ``states``."""
    return ", ".join(f"CASE WHEN gone THEN NULL WHEN r = '{role}' THEN {_plus(f's{i}', 'cut', 'K')} "
                     f"ELSE {_plus(f's{i}', '2 + cut', 'R')} END" for i in states)


def repair_sql() -> str:
    """op12 by a recursive query over the rows of each conversation, an entry for each state of the roles."""
    return f"""
        WITH RECURSIVE tab AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
        src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                       coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
                FROM conversations),
        kinds AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295, list_transform(
                      range(1, length(k) + 1), lambda i: CAST(ascii(substr(k, i, 1)) AS BIGINT))),
                      lambda c, b: xor(c >> 8, tab[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS kind
                  FROM src, tab),
        damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                           CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                           unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
        numbered AS (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body,
                            row_number() OVER (PARTITION BY conv_id
                                               ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i
                     FROM damaged),
        marked AS (SELECT *, left(role, 1) AS r, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS r0,
                          CASE WHEN body = '' THEN 'blank'
                               WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1
                                   THEN 'duplicate'
                               WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
                   FROM numbered),
        rules AS (SELECT conv_id, i, r, fault IN ('blank', 'duplicate') AS gone,
                         CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM marked),
        walk AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1,
                   '000000002I' AS s2, '000000004II' AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
            UNION ALL
            SELECT conv_id, i, n0, n1,
                   least(n2, {_plus('n0', '2', 'I')}, {_plus('n1', '2', 'I')}, {_plus('n3', '2', 'I')}),
                   least(n3, {_plus('n2', '2', 'I')}, {_plus('n0', '4', 'II')}, {_plus('n1', '4', 'II')})
            FROM (SELECT w.conv_id, q.i, {_plus('s0', '3', 'D')} AS n0,
                         least({_plus('s1', '3', 'D')},
                               CASE WHEN NOT gone AND r = 's' THEN {_plus('s0', 'cut', 'K')} END) AS n1,
                         least({_plus('s2', '3', 'D')}, {_reads('u', '013')}) AS n2,
                         least({_plus('s3', '3', 'D')}, {_reads('a', '2')}) AS n3
                  FROM walk w JOIN rules q ON q.conv_id IS NOT DISTINCT FROM w.conv_id AND q.i = w.i + 1)),
        ends AS (SELECT conv_id, arg_max(least(s0, s3), i) AS best FROM walk GROUP BY conv_id),
        edits AS (SELECT conv_id, substr(best, 10) AS audit, unnest(range(1, length(best) - 8)) AS p FROM ends),
        placed AS (SELECT conv_id, p, substr(audit, p, 1) AS e,
                          length(replace(substr(audit, 1, p), 'I', '')) AS i,
                          length(replace(substr(audit, 1, p), 'D', '')) AS q,
                          length(replace(audit, 'D', '')) % 2 AS odd FROM edits),
        texts AS (SELECT d.conv_id, string_agg(
                      CASE WHEN e = 'K' THEN role WHEN (q - 1 - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END
                      || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS whole
                  FROM placed d LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.i = d.i
                  WHERE e <> 'D' GROUP BY d.conv_id),
        counted AS (SELECT conv_id, CAST(max(turn) - min(turn) + 1 - count(DISTINCT turn) AS BIGINT) AS gaps,
                           count(*) FILTER (fault = 'blank') AS blank,
                           count(*) FILTER (fault = 'duplicate') AS duplicate,
                           count(*) FILTER (fault = 'truncated') AS truncated,
                           count(*) FILTER (r0 || r NOT IN ('su', 'ua', 'au')) AS illegal
                    FROM marked GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank,
               coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, CAST(substr(best, 1, 9) AS BIGINT) AS cost,
               substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
        FROM ends e LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
             LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE_SQL: dict[str, str] = {
    "op3_warc_zip": """
        WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex,
                     max(page_id) OVER (PARTITION BY html) AS owner FROM t)
        SELECT page_id, payload_bytes,
               list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (i // 4), 5) AS BIGINT)
                             >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1)), 'string_agg', '') AS payload_digest,
               CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id < owner THEN owner END AS refers_to
        FROM d""",
    # the pages at hand mark their content with one article element and escape five characters
    "op5_main_text": """
        WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x
                   FROM pages),
        b AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                  regexp_replace(x, '<[^>]*>', chr(1), 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'),
                  '&quot;?', '"', 'g'), '&#x27;?', chr(39), 'g'), '&amp;?', '&', 'g') AS x FROM a),
        c AS (SELECT page_id, url, regexp_replace(regexp_replace(x, '[ \\t\\r\\n]+', ' ', 'g'),
                  ' ?(\\x01 ?)+', chr(10), 'g') AS x FROM b)
        SELECT page_id, url, trim(x, chr(10) || ' ') AS text, length(trim(x, chr(10) || ' ')) AS n_chars FROM c""",
    "op9_exact_dedup": """
        WITH t AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                     'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op10_topk_threshold": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id,
                     CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
              FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER)
                     AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 20""",
    "op12_conversation_grammar": repair_sql(),
    "op13_filter_audit": """
        WITH docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
        split AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
                  FROM docs),
        tests AS (SELECT doc_id, part,
                         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
                         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
                         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t)
                                 THEN 'C' ELSE '' END
                         || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
                  FROM split),
        counts AS (SELECT part, fails,
                          doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good,
                          doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic,
                          count(*) AS n FROM tests GROUP BY ALL),
        f(f) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
        orders AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e
                   WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
        steps AS (SELECT o, CAST(s AS INTEGER) AS s, substr(o, s, 1) AS f, substr(o, 1, s - 1) AS before
                  FROM orders, range(1, 6) r(s)),
        cells AS (SELECT part, o, s, f, n, good, toxic, contains(fails, f) AS bad, fails = f AS alone,
                         translate(before, fails, '') <> before AS gone FROM counts, steps),
        sums AS (SELECT part, o, s, f, coalesce(sum(n) FILTER (NOT bad AND NOT gone), 0) AS kept,
                        coalesce(sum(n) FILTER (bad AND NOT gone), 0) AS removed,
                        coalesce(sum(n) FILTER (bad AND gone), 0) AS redundant,
                        coalesce(sum(n) FILTER (alone), 0) AS unique_fails,
                        coalesce(sum(n) FILTER (bad AND NOT gone AND good), 0) AS good_lost,
                        coalesce(sum(n) FILTER (bad AND NOT gone AND toxic), 0) AS toxic_lost
                 FROM cells GROUP BY part, o, s, f)
        SELECT part, o AS filter_order, s AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM sums""",
}
