"""Registered join and lookup queries and the vocabulary matcher."""

from __future__ import annotations

from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import lookup, title_case
from paysift.functions.sampling import hash_split
from paysift.operators import rules as R
from paysift.operators import text as TX
from paysift.operators.ranking import top_n_per_group
from paysift.operators.selection import grouped_stats
from paysift.plans.common import round_doubles, sql_case
from paysift.plans.marts import cleaned, stored_clean
from paysift.plans.registry import register
from paysift.plans.sql import hash_bucket, title_case as sql_title, with_base
from paysift.session import materialize
from paysift.sources.tables import table

_WORDS = r"list_filter(regexp_split_to_array(coalesce({col}, ''), '[^\p{{L}}]+'), lambda x: x <> '')"

_VOCAB_SQL = f"""WITH vocab AS (
  SELECT word, count(*) AS freq FROM (SELECT unnest({_WORDS.format(col='text')}) AS word FROM documents)
  GROUP BY word HAVING count(*) >= 5),
vr AS (SELECT *, row_number() OVER (ORDER BY freq DESC, word) AS vocab_rank FROM vocab),
low AS (SELECT lw, word AS lw_word FROM (
  SELECT lower(word) AS lw, word, row_number() OVER (PARTITION BY lower(word) ORDER BY freq ASC, word DESC) AS r
  FROM vocab) WHERE r = 1),
req AS (SELECT conv_id, turn, CAST(unnest(range(1, len(toks) + 1)) AS INTEGER) AS pos, unnest(toks) AS token
        FROM (SELECT conv_id, turn, {_WORDS.format(col='text')} AS toks FROM conversations)),
matched AS (
  SELECT r.conv_id, r.turn, r.pos, r.token, coalesce(v1.word, v2.word, v3.word, low.lw_word) AS hit
  FROM req r LEFT JOIN vocab v1 ON v1.word = r.token
  LEFT JOIN vocab v2 ON v2.word = {sql_title('r.token')}
  LEFT JOIN vocab v3 ON v3.word = replace(upper(r.token), 'ẞ', 'SS')  -- full case mapping: ß -> SS
  LEFT JOIN low ON low.lw = lower(r.token))"""


def _vocab(spark, sf, ranked=True):
    docs = table(spark, sf, "documents")
    return TX.vocabulary(TX.token_table(docs, ["doc_id"], TX.words("text")), "token", 5, ranked=ranked)


def _requests(spark, sf):
    conv = table(spark, sf, "conversations")
    return TX.token_table(conv, ["conv_id", "turn"], TX.words("text"))


def _matched(spark, sf, vocab=None):
    v = vocab if vocab is not None else _vocab(spark, sf, ranked=False)
    return TX.vocab_match(_requests(spark, sf), ["conv_id", "turn"], v)


@register("vocab_match", _VOCAB_SQL + """
SELECT conv_id, turn, pos, token, hit,
  CASE WHEN hit IS NULL THEN NULL WHEN hit = token THEN token ELSE token || '→' || hit END AS note
FROM matched""")
def vocab_match(spark, sf):
    return _matched(spark, sf)


@register("skill_note_status", _VOCAB_SQL + """,
agg AS (SELECT conv_id, turn, count(*) AS n_input, count(hit) AS n_matched FROM matched GROUP BY 1, 2)
SELECT c.conv_id, c.turn, coalesce(n_input, 0) AS n_input, coalesce(n_matched, 0) AS n_matched,
  CASE WHEN coalesce(n_input, 0) = 0 THEN 'info' WHEN n_matched > 0 THEN 'ok' ELSE 'warn' END AS status,
  CAST(coalesce(n_matched, 0) AS VARCHAR) || '/' || CAST(coalesce(n_input, 0) AS VARCHAR) AS matched_of_total
FROM conversations c LEFT JOIN agg a ON c.conv_id = a.conv_id AND c.turn = a.turn""")
def skill_note_status(spark, sf):
    m = _matched(spark, sf)
    agg = m.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_input"), F.count("hit").alias("n_matched"))
    conv = table(spark, sf, "conversations").select("conv_id", "turn")
    j = conv.join(agg, ["conv_id", "turn"], "left")
    ni, nm = F.coalesce("n_input", F.lit(0)), F.coalesce("n_matched", F.lit(0))
    return j.select("conv_id", "turn", ni.alias("n_input"), nm.alias("n_matched"),
                    F.when(ni == 0, "info").when(nm > 0, "ok").otherwise("warn").alias("status"),
                    F.concat(nm.cast("string"), F.lit("/"), ni.cast("string")).alias("matched_of_total"))


@register("vocab_hit_rate", _VOCAB_SQL + f""",
ref AS (SELECT DISTINCT unnest({_WORDS.format(col='text')}) AS token FROM benchmark)
SELECT count(*) AS n_reference, count(*) FILTER (WHERE token IN (SELECT word FROM vocab)) AS n_hit,
  round(count(*) FILTER (WHERE token IN (SELECT word FROM vocab)) / count(*), 4) AS hit_rate FROM ref""")
def vocab_hit_rate(spark, sf):
    ref = table(spark, sf, "benchmark").select(F.explode(TX.words("text")).alias("token")).distinct()
    v = _vocab(spark, sf, ranked=False).select(F.col("word").alias("token"), F.lit(True).alias("_in"))
    out = ref.join(v, "token", "left").agg(F.count(F.lit(1)).alias("n_reference"),
                                           F.count("_in").alias("n_hit"))
    return round_doubles(out.select("n_reference", "n_hit",
                                    (F.col("n_hit") / F.col("n_reference")).alias("hit_rate")))


@register("unmatched_suggest", _VOCAB_SQL + """,
um AS (SELECT * FROM (
  SELECT conv_id, turn, pos, token, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS k FROM matched WHERE hit IS NULL) WHERE k <= 3),
hits AS (SELECT conv_id, turn, count(hit) = 0 AS none_matched FROM matched GROUP BY 1, 2),
cand AS (
  SELECT u.token, v.word, v.vocab_rank FROM (SELECT DISTINCT token FROM um) u
  JOIN vr v ON contains(lower(u.token), v.word) OR contains(v.word, lower(u.token))),
best AS (SELECT token, arg_min(word, vocab_rank) AS suggestion FROM cand GROUP BY 1)
SELECT um.conv_id, um.turn, um.pos, um.token, CAST(um.k AS INTEGER) AS k, best.suggestion, hits.none_matched
FROM um LEFT JOIN best ON um.token = best.token JOIN hits ON hits.conv_id = um.conv_id AND hits.turn = um.turn""")
def unmatched_suggest(spark, sf):
    """A turn is a request.  Its first three unmatched tokens get a suggestion each; ``none_matched`` says
    that no token of the turn matched, where the serving layer shows them."""
    vocab = _vocab(spark, sf)  # ranked once (checkpointed), shared by both steps
    m = materialize(_matched(spark, sf, vocab))
    request = ["conv_id", "turn"]
    hits = m.groupBy(*request).agg((F.count("hit") == 0).alias("none_matched"))
    first3 = top_n_per_group(m.where(F.col("hit").isNull()).select(*request, "pos", "token"), request, [F.asc("pos")], 3, name="k")
    found = TX.suggest_contained(first3, vocab).join(hits, request)
    return found.select("conv_id", "turn", "pos", "token", F.col("k").cast("int").alias("k"), "suggestion", "none_matched")


@register("join_on_row_key", with_base(f"""
SELECT s.job_id, s.part, c.required_skills FROM
  (SELECT job_id, CASE WHEN {hash_bucket('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part FROM cleaned) s
JOIN cleaned c ON c.job_id = s.job_id WHERE s.part = 'train'"""))
def join_on_row_key(spark, sf):
    c = cleaned(spark, sf)
    split = c.select("job_id", hash_split(F.col("job_id")).alias("part")).where("part = 'train'")
    return split.join(c.select("job_id", "required_skills"), "job_id", "inner")


@register("join_zip_columns", with_base("""
SELECT a.job_id, a.post_year, a.post_month, b.exp_code, b.size_code FROM
  (SELECT job_id, CAST(year(posting_date) AS INTEGER) AS post_year, CAST(month(posting_date) AS INTEGER) AS post_month FROM cleaned) a
JOIN (SELECT job_id, CAST(CASE experience_level WHEN 'EN' THEN 0 WHEN 'MI' THEN 1 WHEN 'SE' THEN 2 WHEN 'EX' THEN 3 END AS INTEGER) AS exp_code,
             CAST(CASE company_size WHEN 'S' THEN 0 WHEN 'M' THEN 1 WHEN 'L' THEN 2 WHEN 'unknown' THEN 0 END AS INTEGER) AS size_code
      FROM cleaned) b ON a.job_id = b.job_id"""))
def join_zip_columns(spark, sf):
    c = cleaned(spark, sf)
    a = c.select("job_id", F.year("posting_date").alias("post_year"), F.month("posting_date").alias("post_month"))
    b = c.select("job_id", lookup("experience_level", K.EXPERIENCE_CODE).cast("int").alias("exp_code"),
                 lookup("company_size", K.SIZE_CODE).cast("int").alias("size_code"))
    # aligned by key, never by position
    return a.join(b, "job_id", "inner")


@register("lookup_map_default", with_base(f"""
SELECT job_id, experience_level,
  coalesce({sql_case('experience_level', K.EXPERIENCE_LABEL)}, 'Unknown') AS exp_label,
  CAST({sql_case('experience_level', K.EXPERIENCE_ORDER)} AS INTEGER) AS exp_order,
  coalesce({sql_case('company_size', K.SIZE_LABEL)}, 'Unknown') AS size_label,
  CAST({sql_case('company_size', K.SIZE_ORDER)} AS INTEGER) AS size_order
FROM cleaned"""))
def lookup_map_default(spark, sf):
    c = cleaned(spark, sf)
    return c.select("job_id", "experience_level",
                    F.coalesce(lookup("experience_level", K.EXPERIENCE_LABEL), F.lit(K.UNKNOWN_LABEL)).alias("exp_label"),
                    lookup("experience_level", K.EXPERIENCE_ORDER).cast("int").alias("exp_order"),
                    F.coalesce(lookup("company_size", K.SIZE_LABEL), F.lit(K.UNKNOWN_LABEL)).alias("size_label"),
                    lookup("company_size", K.SIZE_ORDER).cast("int").alias("size_order"))


@register("lookup_country_name", with_base(f"""
SELECT job_id, country, coalesce({sql_case('country', K.COUNTRY_DISPLAY)}, {sql_title('country')}) AS country_name
FROM cleaned"""))
def lookup_country_name(spark, sf):
    c = cleaned(spark, sf)
    # fixed 20-row dimension: a broadcast whose size is bounded by construction
    dim = spark.createDataFrame(list(K.COUNTRY_DISPLAY.items()), "_k string, _name string")
    j = c.join(F.broadcast(dim), c["country"] == dim["_k"], "left")
    return j.select("job_id", "country", F.coalesce("_name", title_case("country")).alias("country_name"))


@register("benchmark_gap", with_base(f""", bm AS (
  SELECT country, quantile_cont(salary_usd, 0.5) AS benchmark FROM cleaned GROUP BY country)
SELECT c.job_id, c.country, round(c.salary_usd, 4) AS salary_usd,
  round(coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}), 4) AS benchmark,
  round(c.salary_usd - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}), 4) AS gap,
  CASE WHEN c.salary_usd - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}) > {K.BENCHMARK_BAND} THEN 'above'
       WHEN c.salary_usd - coalesce(bm.benchmark, {K.BENCHMARK_DEFAULT}) < -{K.BENCHMARK_BAND} THEN 'below'
       ELSE 'level' END AS geo_band
FROM cleaned c LEFT JOIN bm ON c.country = bm.country"""))
def benchmark_gap(spark, sf):
    c = stored_clean(spark, sf, "job_id", "country", "salary_usd")
    bm = grouped_stats(c, ["country"], "salary_usd", {"_n": "count"}, {"benchmark": 0.5})
    j = c.join(materialize(bm.drop("_n")), "country", "left")
    b = F.coalesce(F.col("benchmark"), F.lit(float(K.BENCHMARK_DEFAULT)))
    gap = F.col("salary_usd") - b
    return round_doubles(j.select("job_id", "country", "salary_usd", b.alias("benchmark"), gap.alias("gap"),
                                  R.benchmark_band(gap).alias("geo_band")))


@register("parent_child_join", """
WITH users AS (SELECT user_id, min(ts) AS first_ts, count(*) AS n_events FROM events GROUP BY user_id)
SELECT e.user_id, e.event_id, e.event_type, u.first_ts, u.n_events, e.ts = u.first_ts AS is_first
FROM events e JOIN users u ON e.user_id = u.user_id""")
def parent_child_join(spark, sf):
    e = table(spark, sf, "events")
    users = e.groupBy("user_id").agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n_events"))
    j = e.join(users, "user_id", "inner")
    return j.select("user_id", "event_id", "event_type", "first_ts", "n_events",
                    (F.col("ts") == F.col("first_ts")).alias("is_first"))
