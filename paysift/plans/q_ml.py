"""Registered feature-engineering and model queries.

SQL-expressible steps carry a DuckDB oracle; model fits (word vectors,
boosted trees, search, scoring, contributions) are rows-only checked here and
unit-tested against NumPy in ``tests/``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paysift.functions import constants as K
from paysift.functions.expr import feature_display
from paysift.functions.sampling import hash_split
from paysift.operators import features as FE
from paysift.operators import linear as L
from paysift.operators import ml as M
from paysift.operators import vectors as V
from paysift.operators.selection import grouped_stats, small
from paysift.plans.common import round_doubles
from paysift.plans.marts import cleaned
from paysift.plans.registry import register
from paysift.plans.sql import hash_bucket as sql_hash, title_case, with_base
from paysift.session import materialize, shared_dir, stored
from paysift.sources.tables import table

# Nothing fitted is kept between queries: each one fits on the tables that it is given.
def _encoded(spark, sf):
    """Target, codes, dates and counts of every posting, and its part."""
    c = FE.log_target(cleaned(spark, sf))
    return FE.skill_counts(FE.date_parts(FE.ordinal_codes(c))).withColumn("part", hash_split(F.col("job_id")))


def _tokens_column():
    return F.filter(F.transform("skills_array", lambda x: F.trim(x)), lambda x: x != "")


def _skill_tokens(enc):
    """(job_id, token) for the non-blank skills of every posting."""
    return enc.select("job_id", F.explode(_tokens_column()).alias("token"))


def _token_lists(enc):
    return enc.where("part = 'train'").select(_tokens_column().alias("tokens"))


def _w2v(enc):
    """``word, vector`` from the training part's skill lists; ``enc`` is read several times."""
    return V.train(_token_lists(enc), "tokens", K.EMBEDDING_DIM, K.W2V_PARAMS["windowSize"], K.W2V_PARAMS["minCount"])


@dataclass
class ModelTable:
    """Every posting's feature row, from one written table: ``sparse`` (indices, values), ``vectors`` (``features``), both with job_id,
    experience_level, log_salary, part and the base features; ``names`` (idx, feature) in the model's order; their number; ``rows``, what linear models read."""

    sparse: DataFrame
    vectors: DataFrame
    names: DataFrame
    size: int
    rows: DataFrame | FE.TokenRows


def model_table(spark, sf) -> ModelTable:
    """Base features, missing ones filled as the serving layer does, one place for each level of the one-hot
    columns, and the pooled (mean) skill vector."""
    enc = stored(_encoded(spark, sf).select("job_id", "experience_level", "log_salary", "part", "skills_array", *K.BASE_NUMERIC_FEATURES, *K.ONEHOT_PREFIXES), "encoded")
    words = _w2v(enc)
    index = materialize(FE.level_index(enc, K.ONEHOT_PREFIXES))
    n_levels, n_base = index.count(), len(K.BASE_NUMERIC_FEATURES)
    size = n_base + n_levels + K.EMBEDDING_DIM
    keep = ["job_id", "experience_level", "log_salary", "part", *K.BASE_NUMERIC_FEATURES]
    if FE.vectors_fit(words, K.EMBEDDING_DIM, FE.VECTOR_BYTES):
        t = FE.request_defaults(enc).withColumn("tokens", F.when(F.col("job_id").isNotNull(), _tokens_column()))
        rows = FE.token_rows(t, keep, K.BASE_NUMERIC_FEATURES, K.ONEHOT_PREFIXES, index, n_levels, "tokens", words, K.EMBEDDING_DIM)
        sparse, vectors = rows.frames()
    else:
        pooled = FE.pool_vectors(_skill_tokens(enc), ["job_id"], words, K.EMBEDDING_DIM)
        t = FE.request_defaults(enc.join(pooled, "job_id", "left"))
        joined = FE.sparse_rows(t, K.BASE_NUMERIC_FEATURES, K.ONEHOT_PREFIXES, index, n_levels, "pooled", K.EMBEDDING_DIM)
        sparse, vectors = FE.stored_vectors(joined.select(*keep, "indices", "values"), size)
        rows = sparse
    fixed = [*enumerate(K.BASE_NUMERIC_FEATURES), *((n_base + n_levels + i, f"{K.EMBEDDING_PREFIX}{i}") for i in range(K.EMBEDDING_DIM))]
    names = spark.createDataFrame(fixed, "idx int, feature string").unionByName(index.select((F.col("place") + n_base).cast("int").alias("idx"), "feature"))
    return ModelTable(sparse, vectors, materialize(names), size, rows)


def _gbt_model(m: ModelTable):
    return Pipeline(stages=[M.gbt()]).fit(m.vectors.where("part = 'train'"))


#: The names of all features as SQL has them, in a CTE ``names`` (feature), and their display names.
NAMES_SQL = (", names AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature" for f in K.BASE_NUMERIC_FEATURES)
             + " UNION ALL SELECT '" + K.EMBEDDING_PREFIX + "' || range FROM range(" + str(K.EMBEDDING_DIM) + ")"
             + "".join(f" UNION ALL SELECT DISTINCT '{p}' || {c} FROM cleaned WHERE {c} IS NOT NULL" for c, p in K.ONEHOT_PREFIXES.items()) + ")")
DISPLAY_SQL = ("CASE " + " ".join(f"WHEN feature = '{f}' THEN '{d}'" for f, d in K.FEATURE_DISPLAY.items())
               + " ".join(f" WHEN starts_with(feature, '{p}') THEN '{a}' || " + (title_case(f"substr(feature, {len(p) + 1})") if p == "ctry_" else f"substr(feature, {len(p) + 1})")
                          + f" || '{z}'" for p, a, z in K.FEATURE_PREFIX_DISPLAY) + " ELSE feature END")


# ---- features ---------------------------------------------------------------
@register("feat_log_target", with_base("SELECT job_id, round(ln(salary_usd), 4) AS log_salary FROM cleaned"))
def feat_log_target(spark, sf):
    return round_doubles(FE.log_target(cleaned(spark, sf)).select("job_id", "log_salary"))


@register("feat_ordinal", with_base("""
SELECT job_id, CAST(CASE experience_level WHEN 'EN' THEN 0 WHEN 'MI' THEN 1 WHEN 'SE' THEN 2 WHEN 'EX' THEN 3 END AS INTEGER) AS exp_level_encoded,
  CAST(CASE education_required WHEN 'Bachelor' THEN 0 WHEN 'Master' THEN 1 WHEN 'PhD' THEN 2 WHEN 'Associate' THEN 3
       WHEN 'Unknown' THEN 0 END AS INTEGER) AS edu_level_encoded,
  CAST(CASE company_size WHEN 'S' THEN 0 WHEN 'M' THEN 1 WHEN 'L' THEN 2 WHEN 'unknown' THEN 0 END AS INTEGER) AS size_encoded
FROM cleaned"""))
def feat_ordinal(spark, sf):
    return FE.ordinal_codes(cleaned(spark, sf)).select("job_id", "exp_level_encoded", "edu_level_encoded",
                                                       "size_encoded")


@register("feat_dates", with_base("""
SELECT job_id, CAST(year(posting_date) AS INTEGER) AS post_year, CAST(month(posting_date) AS INTEGER) AS post_month,
  CAST(quarter(posting_date) AS INTEGER) AS post_quarter, CAST(year(application_deadline) AS INTEGER) AS deadline_year,
  CAST(month(application_deadline) AS INTEGER) AS deadline_month,
  CAST(CASE WHEN application_deadline IS NULL OR posting_date IS NULL THEN NULL
       ELSE greatest(date_diff('day', posting_date, application_deadline), 0) END AS INTEGER) AS days_to_deadline
FROM cleaned"""))
def feat_dates(spark, sf):
    return FE.date_parts(cleaned(spark, sf)).select("job_id", "post_year", "post_month", "post_quarter",
                                                    "deadline_year", "deadline_month", "days_to_deadline")


@register("feat_skill_count", with_base("""
SELECT job_id, CAST(len(skills_array) AS INTEGER) AS skill_count,
  CAST(len(list_filter(skills_array, lambda x: trim(x) <> '')) AS INTEGER) AS skill_count_nonblank FROM cleaned"""))
def feat_skill_count(spark, sf):
    return FE.skill_counts(cleaned(spark, sf)).select("job_id", "skill_count", "skill_count_nonblank")


@register("feat_onehot", with_base("""
SELECT job_id, 'ind_' || industry AS feature, CAST(1 AS BIGINT) AS value FROM cleaned WHERE industry IS NOT NULL
UNION ALL SELECT job_id, 'emp_' || employment_type, 1 FROM cleaned WHERE employment_type IS NOT NULL
UNION ALL SELECT job_id, 'ctry_' || country, 1 FROM cleaned WHERE country IS NOT NULL"""))
def feat_onehot(spark, sf):
    return FE.onehot_long(cleaned(spark, sf), ["job_id"], K.ONEHOT_PREFIXES)


def _filled_sql() -> str:
    """The base numeric features with the serving layer's defaults, as a CTE ``filled``."""
    d, (year, month) = K.SCORE_DEFAULTS, (int(x) for x in K.SCORE_AS_OF.split("-")[:2])
    code = lambda col, m, default: (f"coalesce(CASE {col} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + f" END, {default})")
    exprs = {
        "remote_ratio": f"coalesce(remote_ratio, {d['remote_ratio']})", "years_experience": f"coalesce(years_experience, {d['years_experience']})",
        "job_description_length": f"coalesce(job_description_length, {d['job_description_length']})",
        "benefits_score": f"coalesce(benefits_score, {d['benefits_score']})",
        "exp_level_encoded": code("experience_level", K.EXPERIENCE_CODE, K.EXPERIENCE_DEFAULT),
        "edu_level_encoded": code("education_required", K.EDUCATION_CODE, K.EDUCATION_DEFAULT),
        "size_encoded": code("company_size", K.SIZE_CODE, K.SIZE_DEFAULT),
        "post_year": f"coalesce(year(posting_date), {year})", "post_month": f"coalesce(month(posting_date), {month})",
        "post_quarter": f"coalesce(quarter(posting_date), {(month - 1) // 3 + 1})",
        "deadline_year": f"coalesce(year(application_deadline), {year + month // 12})",
        "deadline_month": f"coalesce(month(application_deadline), {month % 12 + 1})",
        "days_to_deadline": "CASE WHEN application_deadline IS NULL OR posting_date IS NULL THEN "
                            f"{d['days_to_deadline']} ELSE greatest(date_diff('day', posting_date, application_deadline), 0) END",
        "skill_count": f"coalesce(len(skills_array), {d['skill_count']})"}
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in exprs.items())
    return (f"filled AS (SELECT job_id, experience_level AS level, ln(salary_usd) AS y, "
            f"CASE WHEN {sql_hash('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part, {cols} FROM cleaned)")


FILLED = _filled_sql()


@register("feat_assemble", with_base(f""", {FILLED}{NAMES_SQL},
vocab AS (SELECT word FROM (SELECT trim(unnest(skills_array)) AS word FROM cleaned WHERE {sql_hash('job_id', 10)} < 8)
  WHERE word <> '' GROUP BY word HAVING count(*) >= {K.W2V_PARAMS['minCount']}),
known AS (SELECT DISTINCT job_id FROM (SELECT job_id, trim(unnest(skills_array)) AS word FROM cleaned) JOIN vocab USING (word))
SELECT job_id, {", ".join(f"round(filled.{c}, 4) AS {c}" for c in K.BASE_NUMERIC_FEATURES)},
  concat_ws('|', 'ctry_' || country, 'emp_' || employment_type, 'ind_' || industry) AS ones,
  (SELECT CAST(count(*) AS INTEGER) FROM names) AS n_features, job_id IN (SELECT job_id FROM known) AS has_vector
FROM filled JOIN cleaned USING (job_id)"""))
def feat_assemble(spark, sf):
    """The whole row as the model takes it, read back from its vector: the base features in their order, the names of the places
    that hold a one, the vector's size, and whether its skill part holds anything."""
    m = model_table(spark, sf)
    n_base, after = len(K.BASE_NUMERIC_FEATURES), m.size - K.EMBEDDING_DIM
    rows = m.vectors.select("job_id", F.col("features").alias("v"), vector_to_array("features").alias("f"))
    dense = rows.select("job_id", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(K.BASE_NUMERIC_FEATURES)],
                        F.size("f").alias("n_features"), F.exists(F.slice("f", after + 1, K.EMBEDDING_DIM), lambda x: x != 0).alias("has_vector"))
    hot = m.sparse.select("job_id", F.explode(F.filter("indices", lambda i: (i >= n_base) & (i < after))).alias("idx"))
    ones = hot.join(small(m.names, m.size), "idx").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "feature"))), lambda x: x["feature"]), "|").alias("ones"))
    return round_doubles(dense.join(ones, "job_id", "left").withColumn("ones", F.coalesce("ones", F.lit(""))))


@register("split_random", with_base(f"""
SELECT job_id, CASE WHEN {sql_hash('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part FROM cleaned"""))
def split_random(spark, sf):
    return cleaned(spark, sf).select("job_id", hash_split(F.col("job_id")).alias("part"))


@register("w2v_vocab", with_base(f"""
SELECT word, count(*) AS freq FROM (
  SELECT trim(unnest(skills_array)) AS word FROM cleaned WHERE {sql_hash('job_id', 10)} < 8)
WHERE word <> '' GROUP BY word HAVING count(*) >= 5"""))
def w2v_vocab(spark, sf):
    enc = _encoded(spark, sf).where("part = 'train'")
    return (_skill_tokens(enc).groupBy(F.col("token").alias("word")).agg(F.count(F.lit(1)).alias("freq"))
            .where(F.col("freq") >= K.W2V_PARAMS["minCount"]))


@register("w2v_pairs", with_base(f""", t AS (
  SELECT job_id, list_filter(list_transform(skills_array, lambda x: trim(x)), lambda x: x <> '') AS w FROM cleaned WHERE {sql_hash('job_id', 10)} < 8),
p AS (SELECT job_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM t),
v AS (SELECT word, count(*) AS freq FROM p GROUP BY word HAVING count(*) >= {K.W2V_PARAMS['minCount']}),
a AS (SELECT a.word, b.word AS other FROM p a JOIN p b ON a.job_id = b.job_id AND b.i > a.i AND b.i <= a.i + {K.W2V_PARAMS['windowSize']} WHERE a.word <> b.word)
SELECT word, other, count(*) AS n FROM (SELECT word, other FROM a UNION ALL SELECT other, word FROM a)
WHERE word IN (SELECT word FROM v) AND other IN (SELECT word FROM v) GROUP BY ALL
UNION ALL SELECT word, word, freq FROM v"""))
def w2v_pairs(spark, sf):
    """The counts that the word vectors are made of."""
    lists = materialize(_token_lists(_encoded(spark, sf)))
    return V.cooccurrences(lists, "tokens", K.W2V_PARAMS["windowSize"], K.W2V_PARAMS["minCount"])[1]


@register("w2v_train")
def w2v_train(spark, sf):
    return _w2v(stored(_encoded(spark, sf).select("part", "skills_array"), "skills")).select("word", F.size("vector").alias("dim"), "vector")


@register("w2v_check", with_base(f"""
SELECT word, CAST({K.EMBEDDING_DIM} AS INTEGER) AS dim, TRUE AS has_direction FROM (
  SELECT trim(unnest(skills_array)) AS word FROM cleaned WHERE {sql_hash('job_id', 10)} < 8)
WHERE word <> '' GROUP BY word HAVING count(*) >= {K.W2V_PARAMS['minCount']}"""))
def w2v_check(spark, sf):
    """The fitted vocabulary, and that each word has a finite vector of the asked size."""
    v = w2v_train(spark, sf)
    norm = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return v.select("word", "dim", ((norm > 0) & ~F.isnan(norm)).alias("has_direction"))


_POOL_SQL = """
SELECT label, dim, round({agg}(CAST(x AS DOUBLE)), 4) AS value FROM (
  SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding) AS x FROM embeddings)
GROUP BY label, dim"""


def _pool(spark, sf, how):
    e = table(spark, sf, "embeddings")
    # rows = labels, tokens = the vector ids filed under each label
    tokens = e.select("label", F.col("vec_id").alias("token"))
    vecs = e.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    p = FE.pool_vectors(tokens, ["label"], vecs, 64, how=how)
    return round_doubles(p.select("label", F.posexplode("pooled").alias("dim", "value"))
                          .withColumn("dim", F.col("dim").cast("long")))


@register("pool_mean", _POOL_SQL.format(agg="avg"))
def pool_mean(spark, sf):
    return _pool(spark, sf, "mean")


@register("pool_max", _POOL_SQL.format(agg="max"))
def pool_max(spark, sf):
    return _pool(spark, sf, "max")


# ---- models -------------------------------------------------------------------
TEST_ROWS = f"SELECT count(*) FROM cleaned WHERE {sql_hash('job_id', 10)} >= 8"


@register("gbt_train")
def gbt_train(spark, sf):
    m = model_table(spark, sf)
    return round_doubles(M.regression_metrics(_gbt_model(m).transform(m.vectors.where("part = 'test'")), "log_salary"))


@register("gbt_fit_check", with_base(NAMES_SQL + """
SELECT 'posting' AS kind, CAST(job_id AS VARCHAR) AS name, CAST(1 AS BIGINT) AS n, TRUE AS ok FROM cleaned
UNION ALL SELECT 'feature', feature, 1, TRUE FROM names UNION ALL SELECT 'total', 'importance', 1, TRUE"""))
def gbt_fit_check(spark, sf):
    """What must hold of the real fit: each posting scored once with low <= point <= high in the fixed proportions, every
    feature named once with a share between 0 and 1, and shares that add up to 1."""
    m = model_table(spark, sf)
    model = _gbt_model(m)
    s = M.score(model, m.vectors, ["job_id"])
    order = (F.col("low") <= F.col("point")) & (F.col("point") <= F.col("high")) & (F.col("point") == F.floor(F.exp("log_pred"))) & (F.col("point") > 0)
    scored = s.groupBy(F.col("job_id").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(order).alias("ok"))
    imp = materialize(M.gain_importances(spark, model.stages[-1], m.names))
    named = imp.groupBy(F.col("feature").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("importance").between(0, 1)).alias("ok"))
    total = imp.agg(F.lit("importance").alias("name"), F.lit(1).cast("long").alias("n"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("ok"))
    rows = None
    for kind, part in (("posting", scored), ("feature", named), ("total", total)):
        part = part.select(F.lit(kind).alias("kind"), "name", "n", "ok")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@register("gbt_check", with_base(f"SELECT ({TEST_ROWS}) AS n, TRUE AS learns"))
def gbt_check(spark, sf):
    """The same trees on a planted signal of level and years: they must explain nine tenths of it on held-out rows."""
    t = FE.request_defaults(FE.ordinal_codes(cleaned(spark, sf)).withColumn("part", hash_split(F.col("job_id"))))
    t = materialize(t.withColumn("planted", 0.4 * F.col("exp_level_encoded") + 0.03 * F.col("years_experience")))
    pipe = Pipeline(stages=[M.assembler(["exp_level_encoded", "years_experience", "benefits_score", "size_encoded"]),
                            M.gbt(label="planted", params={"maxIter": 20})])
    m = M.regression_metrics(pipe.fit(t.where("part = 'train'")).transform(t.where("part = 'test'")), "planted")
    return m.select("n", (F.col("r2") > 0.9).alias("learns"))


@register("gain_importance")
def gain_importance(spark, sf):
    m = model_table(spark, sf)
    imp = M.gain_importances(spark, _gbt_model(m).stages[-1], m.names)
    return round_doubles(imp.select("feature", feature_display("feature").alias("display_name"), "importance"))


@register("score_batch")
def score_batch(spark, sf):
    """Every posting scored."""
    m = model_table(spark, sf)
    return round_doubles(M.score(_gbt_model(m), m.vectors, ["job_id"]))


@register("eval_regression", with_base(f""", f AS (
  SELECT country, experience_level, ln(salary_usd) AS y,
         CASE WHEN {sql_hash('job_id', 10)} < 8 THEN 'train' ELSE 'test' END AS part FROM cleaned),
g AS (SELECT country, experience_level, avg(y) AS gm FROM f WHERE part = 'train' GROUP BY 1, 2),
p AS (SELECT f.y, coalesce(g.gm, (SELECT avg(y) FROM f WHERE part = 'train')) AS pred
      FROM f LEFT JOIN g ON f.country = g.country AND f.experience_level = g.experience_level WHERE part = 'test')
SELECT count(*) AS n, round(sqrt(avg((y - pred) * (y - pred))), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae,
  round(1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)), 4) AS r2 FROM p"""))
def eval_regression(spark, sf):
    """Metrics of a given predictor: the training mean of log salary per (country, level)."""
    c = cleaned(spark, sf).select("job_id", "country", "experience_level", F.ln("salary_usd").alias("log_salary"),
                                  hash_split(F.col("job_id")).alias("part"))
    tr = c.where("part = 'train'")
    # group means and the overall fallback mean from one grouping-sets pass over the training rows
    means = materialize(tr.groupingSets([["country", "experience_level"], []], "country", "experience_level")
                          .agg(F.avg("log_salary").alias("gm"), F.grouping_id().alias("_gid")))
    g = means.where("_gid = 0").drop("_gid")
    overall = means.where("_gid = 3").first()["gm"]  # a scalar read from the small checkpoint
    p = (c.where("part = 'test'").join(g, ["country", "experience_level"], "left")
          .withColumn("prediction", F.coalesce("gm", F.lit(overall))))
    return round_doubles(M.regression_metrics(p, "log_salary"))


EXPLAINED = ["exp_level_encoded", "years_experience"]

#: Least squares on two features in closed form, and each row's contributions.
LINEAR_SQL = f""", {FILLED},
s AS (SELECT avg(exp_level_encoded) AS m1, avg(years_experience) AS m2, avg(y) AS my,
  var_pop(exp_level_encoded) AS c11, covar_pop(exp_level_encoded, years_experience) AS c12, var_pop(years_experience) AS c22,
  covar_pop(exp_level_encoded, y) AS d1, covar_pop(years_experience, y) AS d2 FROM filled WHERE part = 'train'),
b AS (SELECT m1, m2, my, (d1 * c22 - d2 * c12) / (c11 * c22 - c12 * c12) AS b1, (d2 * c11 - d1 * c12) / (c11 * c22 - c12 * c12) AS b2 FROM s),
w AS (SELECT job_id, level, exp_level_encoded AS x1, years_experience AS x2, my AS base,
  b1 * (exp_level_encoded - m1) AS k1, b2 * (years_experience - m2) AS k2 FROM filled, b),
k AS (SELECT job_id, level, base, 'exp_level_encoded' AS feature, x1 AS value, k1 AS contribution, base + k1 + k2 AS prediction FROM w
  UNION ALL SELECT job_id, level, base, 'years_experience', x2, k2, base + k1 + k2 FROM w)"""


def contributions(spark, sf):
    """(job_id, contributions, base, prediction) of every posting, from the linear model on ``EXPLAINED``."""
    t = FE.ordinal_codes(FE.log_target(cleaned(spark, sf))).withColumn("part", hash_split(F.col("job_id")))
    t = materialize(FE.request_defaults(t).select("job_id", "experience_level", "log_salary", "part", *EXPLAINED))
    _, wide = M.linear_contributions(t, ["job_id", "experience_level"] + [F.col(f).cast("double").alias(f) for f in EXPLAINED], EXPLAINED,
                                     "log_salary", train=t.where("part = 'train'"))
    return wide


def explained(spark, sf):
    """The model table and the linear model on all of its features, fitted on the training part."""
    m = model_table(spark, sf)
    return m, L.fit(m.rows.where("part = 'train'"), m.size, "log_salary")


def _top(m, model):
    return L.contributions_top(m.rows, "job_id", model, K.TOP_CONTRIBUTIONS)


@register("contrib_additive")
def contrib_additive(spark, sf):
    """Each posting's largest contributions in the model on all features, with base and prediction."""
    m, model = explained(spark, sf)
    return round_doubles(_top(m, model).join(small(m.names, m.size), "idx").select("job_id", "rank", "feature", "contribution", "base", "prediction"))


@register("contrib_additive_check", with_base(f"""
SELECT job_id, CAST({K.TOP_CONTRIBUTIONS} AS BIGINT) AS n_top, round((SELECT avg(ln(salary_usd)) FROM cleaned WHERE {sql_hash('job_id', 10)} < 8), 4) AS base, TRUE AS falling, TRUE AS adds_up
FROM cleaned"""))
def contrib_additive_check(spark, sf):
    """What must hold of every explained posting: so many contributions, falling in size, and base + all contributions = prediction."""
    m, model = explained(spark, sf)
    # the contributions of a rank, for rows that share their id the least and the greatest: plain numbers, added up map-side
    at = lambda f, i: f(F.when(F.col("rank") == i, F.abs("contribution")))
    ranks = range(1, K.TOP_CONTRIBUTIONS + 1)
    rows = _top(m, model).groupBy("job_id").agg(
        F.count(F.lit(1)).alias("n_top"), F.max("base").alias("base"), F.bool_and(F.abs(F.col("base") + F.col("total") - F.col("prediction")) < 1e-9).alias("adds_up"),
        *[at(F.min, i).alias(f"_lo{i}") for i in ranks], *[at(F.max, i).alias(f"_hi{i}") for i in ranks])
    falling = F.lit(True)
    for i in ranks:
        falling = falling & F.coalesce(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.lit(True))
        if i > 1:
            falling = falling & F.coalesce(F.col(f"_lo{i - 1}") >= F.col(f"_hi{i}"), F.lit(True))
    return round_doubles(rows.select("job_id", "n_top", "base", falling.alias("falling"), "adds_up"))


@register("importance_mean_abs")
def importance_mean_abs(spark, sf):
    """Every feature's mean absolute contribution in the model on all features."""
    m, model = explained(spark, sf)
    imp = L.mean_abs(m.rows, model).join(m.names, "idx")
    return round_doubles(imp.select("feature", feature_display("feature").alias("display_name"), "importance"))


@register("importance_check", with_base(f"""{NAMES_SQL} SELECT feature, {DISPLAY_SQL} AS display_name, TRUE AS least_squares, TRUE AS not_negative FROM names"""))
def importance_check(spark, sf):
    """Every feature by name, that the residuals of the fit have no product with it (so it is the least-squares fit), and its importance's sign."""
    m, model = explained(spark, sf)
    left = L.residual_products(m.rows.where("part = 'train'"), model, "log_salary")
    rows = m.names.join(left, "idx", "left").join(L.mean_abs(m.rows, model), "idx", "left")
    return rows.select("feature", feature_display("feature").alias("display_name"), (F.abs("product") < 1e-6).alias("least_squares"), (F.col("importance") >= 0).alias("not_negative"))


def _dependence(spark, sf):
    m, model = explained(spark, sf)
    return L.dependence(m.rows, [K.BASE_NUMERIC_FEATURES.index(f) for f in EXPLAINED], model, "experience_level").join(m.names, "idx")


@register("dependence_table")
def dependence_table(spark, sf):
    """How the contributions of level and years depend on value and level in the model on all features: count, mean and percentiles by bin."""
    return round_doubles(_dependence(spark, sf).select("feature", "bin", "lo", "hi", "experience_level", "n", "mean_contribution", "p10", "p50", "p90"))


@register("dependence_check", with_base(f""", {FILLED},
v AS (""" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, level FROM filled" for f in ("exp_level_encoded", "years_experience")) + """),
e AS (SELECT feature, list_distinct(list(x)) AS cuts FROM (
  SELECT feature, unnest(quantile_cont(value, [k / 20 FOR k IN range(1, 20)])) AS x FROM v GROUP BY feature) GROUP BY feature),
b AS (SELECT v.feature, level, value, CAST(len(list_filter(cuts, lambda c: c < value)) AS INTEGER) AS bin FROM v JOIN e USING (feature)),
s AS (SELECT feature, bin, min(value) AS lo, max(value) AS hi FROM b GROUP BY ALL)
SELECT feature, bin, round(lo, 4) AS lo, round(hi, 4) AS hi, level AS experience_level, count(*) AS n, TRUE AS within FROM b JOIN s USING (feature, bin) GROUP BY ALL"""))
def dependence_check(spark, sf):
    """The table's bins and counts, and that its percentiles rise around the mean's range."""
    d = _dependence(spark, sf)
    ok = (F.col("p10") <= F.col("p50")) & (F.col("p50") <= F.col("p90")) & F.col("mean_contribution").isNotNull()
    return round_doubles(d.select("feature", "bin", "lo", "hi", "experience_level", "n", ok.alias("within")))


# the model on two features, which SQL can solve in closed form
@register("contrib_additive_two", with_base(LINEAR_SQL + """
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY abs(contribution) DESC, feature) AS rank, feature,
  round(contribution, 4) AS contribution, round(base, 4) AS base, round(prediction, 4) AS prediction FROM k"""))
def contrib_additive_two(spark, sf):
    """Each posting's contributions of level and years, with base and prediction: they add up."""
    return round_doubles(M.top_contributions(contributions(spark, sf), ["job_id"], EXPLAINED))


@register("importance_mean_abs_two", with_base(LINEAR_SQL + """
SELECT feature, CASE feature WHEN 'exp_level_encoded' THEN 'Experience Level' ELSE 'Years of Experience' END AS display_name,
  round(avg(abs(contribution)), 4) AS importance FROM k GROUP BY feature"""))
def importance_mean_abs_two(spark, sf):
    imp = M.mean_abs_importance(contributions(spark, sf), EXPLAINED)
    return round_doubles(imp.select("feature", feature_display("feature").alias("display_name"), "importance"))


@register("dependence_table_two", with_base(LINEAR_SQL + """
SELECT feature, value, level AS experience_level, count(*) AS n, round(avg(contribution), 4) AS mean_contribution,
  round(quantile_cont(contribution, 0.1), 4) AS p10, round(quantile_cont(contribution, 0.5), 4) AS p50,
  round(quantile_cont(contribution, 0.9), 4) AS p90 FROM k GROUP BY feature, value, level"""))
def dependence_table_two(spark, sf):
    """Contributions by the feature's value and the level: count, mean and percentiles."""
    wide = contributions(spark, sf)
    pairs = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(M.contribution_col(f)).alias("c")) for f in EXPLAINED])
    long = wide.select("experience_level", F.explode(pairs).alias("x")).select("experience_level", "x.feature", "x.value", "x.c")
    return round_doubles(grouped_stats(materialize(long), ["feature", "value", "experience_level"], "c", {"n": "rows", "mean_contribution": "mean:8"},
                                       {"p10": 0.1, "p50": 0.5, "p90": 0.9}))


@register("model_save_load", with_base(f"SELECT ({TEST_ROWS}) AS n, ({TEST_ROWS}) AS n_equal"))
def model_save_load(spark, sf):
    from pyspark.ml import PipelineModel
    m = model_table(spark, sf)
    model = _gbt_model(m)
    path = shared_dir(spark, "model")
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    test = m.vectors.where("part = 'test'")
    a = model.transform(test).select("job_id", F.col("prediction").alias("p0"))
    b = loaded.transform(test).select("job_id", F.col("prediction").alias("p1"))
    j = a.join(b, "job_id")
    return j.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("p0") == F.col("p1")).alias("n_equal"))
