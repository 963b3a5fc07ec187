"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paysift.llm import (decontamination, fim, html_extraction, license_scan, lm_scoring, packing, pii, quality_rules, simhash_dedup,
                         suffix_dedup, toxicity, warc, whitening)
from paysift.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.drop("text_hash")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymized(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.cut_out(table(spark, sf_dir, "documents")).drop("kept")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.transform(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_toxicity, op2_decontamination, op3_quality_rules, op4_license_scan, op5_html_extraction, op6_lm_scoring, op7_warc, op8_simhash_dedup,
    op9_pii, op10_packing, op11_suffix_dedup, op12_fill_in_middle, op13_whitening)}

#: op2 by its definition: every window of every item against every span of every document.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT item_id, w, least(13, len(w)) AS n, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
spans AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g FROM (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT doc_id, s, n, item_id FROM spans JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: op7 from the pages themselves.
OP7_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
r AS (SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < response_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < response_id THEN response_id END AS refers_to
FROM p LEFT JOIN r USING (payload_digest)
"""

#: op11 from all 100-byte strings: those that aren't the first of their kind cover what goes.
OP11_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
s AS (SELECT doc_id, p, b[p:p + 99] AS s FROM (SELECT doc_id, b, unnest(generate_series(1, n - 99)) AS p FROM d WHERE n >= 100)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM s) WHERE k > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r)),
spans AS (SELECT doc_id, min(p) AS lo, max(p) + 99 AS hi FROM g GROUP BY doc_id, g),
x AS (SELECT doc_id, sum(hi - lo + 1) AS n_removed, count(*) AS n_spans, list(lo ORDER BY lo) AS los, list(hi ORDER BY lo) AS his FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans IS NULL THEN hex(b) ELSE array_to_string(list_transform(generate_series(1, n_spans + 1), lambda i:
         hex(b[(CASE WHEN i = 1 THEN 1 ELSE his[i - 1] + 1 END):(CASE WHEN i = n_spans + 1 THEN n ELSE los[i] - 1 END)])), '') END)) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""

#: op12 from the lists of lines.
OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id::VARCHAR) AS h, string_split(coalesce(text, ''), chr(10)) AS w FROM documents),
u AS (
  SELECT doc_id, t, h, list_concat(list_transform(w[1:len(w) - 1], lambda x: x || chr(10)), CASE WHEN w[len(w)] = '' THEN [] ELSE [w[len(w)]] END) AS u FROM d),
c AS (
  SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         ('0x' || h[25:32])::BIGINT % 100 < 50 AS spm, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM u),
p AS (
  SELECT doc_id, t, n, spm, plain, array_to_string(u[1:least(a, b)], '') AS pre, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS mid,
         array_to_string(u[greatest(a, b) + 1:], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
       CASE WHEN NOT plain THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE '<P>' || pre || '<S>' || suf || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""

ORACLE: dict[str, str] = {"op2_decontamination": OP2_SQL, "op7_warc": OP7_SQL, "op11_suffix_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
