"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontam, license_scan, lexical_search, line_dedup, packing, pii, quality, secret_scan, simhash,
               suffix_dedup, token_alignment, toxicity, vector_packing)
from .common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(load(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.suffix_dedup(load(spark, sf_dir, "documents")))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.report(load(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(load(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(load(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.pseudonymise(load(spark, sf_dir, "documents")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack(load(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(load(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (op1_toxicity, op2_secrets, op3_suffix_dedup, op4_licenses, op5_simhash, op6_line_dedup,
                            op7_pii, op8_decontamination, op9_packing, op10_quality, op11_vector_packing,
                            op12_token_alignment, op13_lexical_search)}

# One query is whole in SQL: the windows of both tables meet by their text; a proximity match is looked for around the
# rarest terms of a window, of which it must hold one.
_OP8 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bl AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, w[k:k + least(13, len(w)) - 1] AS ws
       FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS k FROM b WHERE len(w) > 0)),
bw AS (SELECT item_id, n, array_to_string(ws, ' ') AS win FROM bl),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN bw USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM m) GROUP BY doc_id),
im AS (SELECT DISTINCT doc_id, item_id FROM m),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM im GROUP BY doc_id),
q AS (SELECT row_number() OVER () AS q, item_id, list_distinct(ws) AS ts FROM bl WHERE item_id IS NOT NULL),
qt AS (SELECT q, len(ts) AS n, (4 * len(ts) + 4) // 5 AS need, unnest(ts) AS term FROM q),
tk AS (SELECT * FROM (SELECT doc_id, unnest(w) AS term, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0)
       WHERE term IN (SELECT term FROM qt)),
cnt AS (SELECT term, count(*) AS c FROM tk GROUP BY term),
lead AS (SELECT * FROM (SELECT qt.*, row_number() OVER (PARTITION BY q ORDER BY coalesce(c, 0), term) AS r
                        FROM qt LEFT JOIN cnt USING (term)) WHERE r <= n - need + 1),
around AS (SELECT q, need, doc_id, p, unnest(generate_series(p - 15, p + 15)) AS p2
           FROM (SELECT DISTINCT q, need, doc_id, p FROM lead JOIN tk USING (term))),
seen AS (SELECT a.q, a.need, a.doc_id, a.p, a.p2, t.term FROM around a JOIN tk t ON t.doc_id = a.doc_id AND t.p = a.p2
         JOIN qt ON qt.q = a.q AND qt.term = t.term),
dense AS (SELECT q, doc_id, p FROM seen GROUP BY q, need, doc_id, p HAVING count(DISTINCT term) >= need),
kept AS (SELECT seen.* FROM seen JOIN dense USING (q, doc_id, p)),
stretch AS (SELECT x.q, x.doc_id, x.p2 AS word FROM kept x JOIN kept y ON x.q = y.q AND x.doc_id = y.doc_id AND x.p = y.p
              AND y.p2 BETWEEN x.p2 AND x.p2 + 15 WHERE x.p2 <= x.p
            GROUP BY x.q, x.need, x.doc_id, x.p, x.p2 HAVING count(DISTINCT y.term) >= x.need),
near AS (SELECT doc_id, item_id, min(word) AS word FROM stretch JOIN q USING (q) GROUP BY doc_id, item_id),
nr AS (SELECT near.doc_id, count(*) FILTER (im.item_id IS NULL) AS n_near,
              string_agg(near.item_id || ':' || word, ',' ORDER BY near.item_id) AS places
       FROM near LEFT JOIN im ON im.doc_id = near.doc_id AND im.item_id = near.item_id GROUP BY near.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near_items, sha256(coalesce(places, '')) AS near_sha256
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id) LEFT JOIN nr USING (doc_id)
"""

ORACLE: dict[str, str] = {"op8_decontamination": _OP8}
