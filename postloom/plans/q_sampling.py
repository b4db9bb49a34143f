"""Queries: sampling, assignment, request plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import config
from postloom.operators import filters as FL
from postloom.operators import sampling as SA
from postloom.plans import sqlfrag as S
from postloom.plans.q_profile import P1_SQL, P2_SQL
from postloom.plans.registry import query, table
from postloom.plans.views import posts, with_posts
from postloom.session import materialize

SEED = "7"
N = config.SAMPLES_PER_PROMPT


def _md5(seed: str, *parts: str) -> str:
    return "md5(" + " || '|' || ".join([S.q(seed)] + [f"CAST({p} AS VARCHAR)" for p in parts]) + ")"


@query("split_exact", "R10", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('42', 'doc_id')}, doc_id) - 1 AS rk, count(*) OVER () AS n
           FROM documents),
 s AS (SELECT *, n - (3 * n + 9) // 10 AS tr, (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 AS va FROM r)
SELECT doc_id, CASE WHEN rk < tr THEN 'train' WHEN rk < tr + va THEN 'val' ELSE 'test' END AS split_group FROM s""")
def split_exact(spark, d):
    return SA.split_exact(table(spark, d, "documents").select("doc_id"), ["doc_id"], "42")


@query("split_sizes", "A14", f"""
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {_md5('42', 'doc_id')}, doc_id) - 1 AS rk, count(*) OVER () AS n
           FROM documents),
 s AS (SELECT *, n - (3 * n + 9) // 10 AS tr, (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 AS va FROM r)
SELECT CASE WHEN rk < tr THEN 'train' WHEN rk < tr + va THEN 'val' ELSE 'test' END AS split_group,
       CAST(count(*) AS BIGINT) AS n FROM s GROUP BY 1""")
def split_sizes(spark, d):
    s = SA.split_exact(table(spark, d, "documents").select("doc_id"), ["doc_id"], "42")
    return s.groupBy("split_group").agg(F.count(F.lit(1)).alias("n"))


@query("random_k", "R1", with_posts(f"""
SELECT platform, post_id, rn FROM (
  SELECT platform, post_id, row_number() OVER (PARTITION BY platform ORDER BY {_md5(SEED, 'post_id')}, post_id) AS rn
  FROM posts_v WHERE {P1_SQL}) WHERE rn <= {N}"""))
def random_k(spark, d):
    return SA.random_k(FL.pool_filter_sql(posts(spark, d)), N, SEED).select("platform", "post_id", "rn")


@query("sample_sketches", "R1/R6", with_posts(f"""
SELECT platform, post_id, rn FROM (
  SELECT platform, post_id, row_number() OVER (PARTITION BY platform ORDER BY {_md5(SEED, 'post_id')}, post_id) AS rn
  FROM posts_v WHERE {P1_SQL}) WHERE rn <= {N}"""))
def sample_sketches(spark, d):
    """A sketch per language and platform, merged into the sample of each platform."""
    pool = FL.pool_filter_sql(posts(spark, d)).withColumn("part", F.concat_ws("|", "language", "platform"))
    parts = SA.sample_sketch(pool, N, SEED, group="part")
    merged = SA.merge_sketches(parts, N)
    return SA.top_k_per_group(merged, ["platform"], N, [F.col("sample_hash"), F.col("post_id")]).select("platform", "post_id", "rn")


@query("seeded_preview", "R6/S9", with_posts(f"""
SELECT platform, post_id, CAST(length(text) AS BIGINT) AS text_length FROM posts_v WHERE {P2_SQL}
ORDER BY {_md5('42', 'post_id')}, post_id LIMIT 100"""))
def seeded_preview(spark, d):
    pool = FL.pool_filter_strip(posts(spark, d))
    return SA.seeded_preview(pool, 100, "42").select("platform", "post_id", F.length("text").cast("long").alias("text_length"))


def _bucket_sql(len_expr: str) -> str:
    b = config.LENGTH_BUCKETS
    blue = " ".join(f"WHEN {len_expr} BETWEEN {lo} AND {hi} THEN '{nm}'" for nm, lo, hi, _ in b["bluesky"])
    dflt = " ".join(f"WHEN {len_expr} BETWEEN {lo} AND {hi} THEN '{nm}'" for nm, lo, hi, _ in b["default"])
    return f"CASE WHEN platform = 'bluesky' THEN (CASE {blue} END) ELSE (CASE {dflt} END) END"


POOL_SQL = f""", pool AS (SELECT platform, post_id, {_bucket_sql('length(text)')} AS bucket FROM posts_v
  WHERE text IS NOT NULL AND trim(text) <> '' AND NOT coalesce(has_media, false))
"""
QS, QM = config.bucket_quotas(N)


@query("stratified_sample", "R2/R3/R5", with_posts(POOL_SQL + f""",
 rk AS (SELECT *, row_number() OVER (PARTITION BY platform, bucket ORDER BY {_md5(SEED, "'bucket'", 'post_id')}, post_id) AS rn
        FROM pool WHERE bucket IS NOT NULL),
 av AS (SELECT platform, count(*) FILTER (WHERE bucket = 'short') AS a_s, count(*) FILTER (WHERE bucket = 'medium') AS a_m,
               count(*) FILTER (WHERE bucket = 'long') AS a_l FROM rk WHERE rn <= {N} GROUP BY platform),
 q AS (SELECT platform, least({QS}, a_s) AS q_s, least({QM}, a_m) AS q_m,
              least({N} - least({QS}, a_s) - least({QM}, a_m), a_l) AS q_l FROM av),
 ch AS (SELECT rk.platform, rk.post_id, rk.bucket FROM rk JOIN q USING (platform)
        WHERE rn <= CASE bucket WHEN 'short' THEN q_s WHEN 'medium' THEN q_m ELSE q_l END),
 need AS (SELECT p.platform, {N} - coalesce(q.q_s + q.q_m + q.q_l, 0) AS need
          FROM (SELECT DISTINCT platform FROM posts_v) p LEFT JOIN q USING (platform)),
 fb AS (SELECT x.platform, x.post_id, 'fallback' AS bucket FROM (
          SELECT p.*, row_number() OVER (PARTITION BY p.platform ORDER BY {_md5(SEED, "'fallback'", 'p.post_id')}, p.post_id) AS rn
          FROM pool p ANTI JOIN ch ON ch.platform = p.platform AND ch.post_id = p.post_id) x
        JOIN need USING (platform) WHERE x.rn <= need.need),
 u AS (SELECT * FROM ch UNION ALL SELECT * FROM fb)
SELECT platform, post_id, bucket,
       row_number() OVER (PARTITION BY platform ORDER BY {_md5(SEED, "'shuffle'", 'post_id')}, post_id) AS pos FROM u"""))
def stratified_sample(spark, d):
    return SA.stratified_sample(posts(spark, d), N, SEED)


@query("stratified_fallback", "R3", with_posts(POOL_SQL + f""",
 rk AS (SELECT *, row_number() OVER (PARTITION BY platform, bucket ORDER BY {_md5(SEED, "'bucket'", 'post_id')}, post_id) AS rn
        FROM pool WHERE bucket IS NOT NULL),
 av AS (SELECT platform, count(*) FILTER (WHERE bucket = 'short') AS a_s, count(*) FILTER (WHERE bucket = 'medium') AS a_m,
               count(*) FILTER (WHERE bucket = 'long') AS a_l FROM rk WHERE rn <= 40 GROUP BY platform),
 q AS (SELECT platform, least(12, a_s) AS q_s, least(16, a_m) AS q_m,
              least(40 - least(12, a_s) - least(16, a_m), a_l) AS q_l FROM av)
SELECT platform, CAST(q_s + q_m + q_l AS BIGINT) AS from_buckets, CAST(40 - (q_s + q_m + q_l) AS BIGINT) AS from_fallback
FROM q"""))
def stratified_fallback(spark, d):
    # 40 examples per platform: thin long buckets force the fallback path
    s = SA.stratified_sample(posts(spark, d), 40, SEED)
    return s.groupBy("platform").agg(
        F.count(F.when(F.col("bucket") != "fallback", 1)).alias("from_buckets"),
        F.count(F.when(F.col("bucket") == "fallback", 1)).alias("from_fallback"))


def _requests(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("request_id"))


def _pool_counts(spark, d):
    return FL.pool_filter_sql(posts(spark, d)).groupBy("platform").agg(F.count(F.lit(1)).alias("n"))


def _model_case(u: str) -> str:
    active = [(k, w) for k, w in config.MODEL_WEIGHTS if w > 0]
    total = sum(w for _, w in active)
    cum, parts = 0.0, []
    for k, w in active[:-1]:
        cum += w
        parts.append(f"WHEN {u} * {total!r} < {cum!r} THEN '{k}'")
    return f"CASE {' '.join(parts)} ELSE '{active[-1][0]}' END"


PLAN_SQL = f""", cnt AS (SELECT platform, count(*) AS n FROM posts_v WHERE {P1_SQL} GROUP BY platform),
 cdf AS (SELECT platform, sum(n) OVER (ORDER BY platform) - n AS lo, sum(n) OVER (ORDER BY platform) AS hi,
                sum(n) OVER () AS tot FROM cnt),
 req AS (SELECT doc_id AS request_id, {S.unit(SEED, "'model'", 'doc_id')} AS u_m, {S.unit(SEED, "'platform'", 'doc_id')} AS u_p,
                {S.u32(SEED, "'n'", 'doc_id')} AS h_n, {S.unit(SEED, "'temp'", 'doc_id')} AS u_t FROM documents),
 plan AS (SELECT r.request_id, c.platform, {_model_case('r.u_m')} AS model,
                 CAST({config.MIN_EXAMPLES} + r.h_n % {config.MAX_EXAMPLES - config.MIN_EXAMPLES + 1} AS INT) AS n_examples, r.u_t
          FROM req r LEFT JOIN cdf c ON r.u_p * c.tot >= c.lo AND r.u_p * c.tot < c.hi)
"""


@query("model_choice", "R7/P11", with_posts(PLAN_SQL + "SELECT request_id, model FROM plan"))
def model_choice(spark, d):
    return SA.choose_model(_requests(spark, d), SEED)


@query("platform_choice", "R8", with_posts(PLAN_SQL + "SELECT request_id, platform FROM plan"))
def platform_choice(spark, d):
    return SA.choose_platform(_requests(spark, d), _pool_counts(spark, d), SEED)


def _temp_sql() -> str:
    t = config.TEMPERATURE_RANGES
    az = ", ".join(f"'{m}'" for m in config.AZURE_MODELS)
    lo = f"CASE WHEN model = 'claude' THEN {t['claude'][0]} WHEN model IN ({az}) THEN {t['azure'][0]} ELSE {t['other'][0]} END"
    hi = f"CASE WHEN model = 'claude' THEN {t['claude'][1]} WHEN model IN ({az}) THEN {t['azure'][1]} ELSE {t['other'][1]} END"
    return f"round(CAST({lo} AS DOUBLE) + u_t * (CAST({hi} AS DOUBLE) - CAST({lo} AS DOUBLE)), 6)"


@query("request_plan", "G1/R9", with_posts(PLAN_SQL + f"""
SELECT request_id, platform, model, n_examples, {_temp_sql()} AS temperature FROM plan"""))
def request_plan(spark, d):
    p = SA.request_plan(_requests(spark, d), _pool_counts(spark, d), SEED)
    return p.select("request_id", "platform", "model", "n_examples", F.round("temperature", 6).alias("temperature"))


EXAMPLES_SQL = POOL_SQL + f""",
 ranked AS (SELECT platform, bucket, post_id,
                   row_number() OVER (PARTITION BY platform, bucket ORDER BY {_md5(SEED, 'post_id')}, post_id) - 1 AS idx,
                   count(*) OVER (PARTITION BY platform, bucket) AS B
            FROM pool WHERE bucket IS NOT NULL),
 sizes AS (SELECT platform, max(B) FILTER (WHERE bucket = 'short') AS B_s, max(B) FILTER (WHERE bucket = 'medium') AS B_m,
                  max(B) FILTER (WHERE bucket = 'long') AS B_l FROM ranked GROUP BY platform),
 r AS (SELECT p.request_id, p.platform, p.n_examples, coalesce(B_s, 0) AS B_s, coalesce(B_m, 0) AS B_m, coalesce(B_l, 0) AS B_l
       FROM plan p LEFT JOIN sizes USING (platform)),
 q AS (SELECT *, least(greatest(1, (n_examples * 3) // 10), B_s) AS q_s, least(greatest(1, (n_examples * 4) // 10), B_m) AS q_m FROM r),
 pb AS (SELECT request_id, platform, 'short' AS bucket, q_s AS q, B_s AS B FROM q
        UNION ALL SELECT request_id, platform, 'medium', q_m, B_m FROM q
        UNION ALL SELECT request_id, platform, 'long', least(n_examples - q_s - q_m, B_l), B_l FROM q),
 slots AS (SELECT request_id, platform, bucket, B, unnest(range(0, q)) AS j FROM pb WHERE q > 0),
 bx AS (SELECT s.request_id, s.platform, s.bucket, s.j, k.post_id
        FROM slots s JOIN ranked k ON k.platform = s.platform AND k.bucket = s.bucket
         AND k.idx = ({S.u32(SEED, "'offset'", 's.request_id', 's.bucket')} + s.j) % s.B),
 anyr AS (SELECT platform, post_id, row_number() OVER (PARTITION BY platform ORDER BY {_md5(SEED + '-any', 'post_id')}, post_id) - 1 AS idx,
                 count(*) OVER (PARTITION BY platform) AS P FROM pool),
 short_of AS (SELECT p.request_id, p.platform, least(p.n_examples, x.P) AS want, least(p.n_examples, x.P) - coalesce(g.got, 0) AS need, x.P
              FROM plan p JOIN (SELECT DISTINCT platform, P FROM anyr) x USING (platform)
              LEFT JOIN (SELECT request_id, count(*) AS got FROM bx GROUP BY request_id) g USING (request_id)),
 fs AS (SELECT request_id, platform, need, P, unnest(range(0, want)) AS j FROM short_of WHERE need > 0),
 fb AS (SELECT f.request_id, f.platform, f.need, k.post_id, row_number() OVER (PARTITION BY f.request_id ORDER BY f.j) - 1 AS j
        FROM fs f JOIN anyr k ON k.platform = f.platform AND k.idx = ({S.u32(SEED, "'offset'", 'f.request_id', "'fallback'")} + f.j) % f.P
        ANTI JOIN bx ON bx.request_id = f.request_id AND bx.post_id = k.post_id),
 ex AS (SELECT * FROM bx UNION ALL SELECT request_id, platform, 'fallback', j, post_id FROM fb WHERE j < need)
"""


@query("request_examples", "R4", with_posts(PLAN_SQL + EXAMPLES_SQL + "SELECT request_id, platform, bucket, j, post_id FROM ex"))
def request_examples(spark, d):
    return examples_for_requests(spark, d).select("request_id", "platform", "bucket", "j", "post_id")


def request_plan_df(spark, d):
    """The request plan, stored: every query on prompts reads it more than once."""
    return materialize(SA.request_plan(_requests(spark, d), _pool_counts(spark, d), SEED), "request-plan")


def examples_for_requests(spark, d, plan=None):
    plan = plan if plan is not None else request_plan_df(spark, d)
    return SA.request_examples(plan.select("request_id", "platform", "n_examples"), posts(spark, d), SEED)
