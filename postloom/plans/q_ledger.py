"""Queries: cost ledger, run log, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from postloom import config
from postloom.operators import ledger as LG
from postloom.operators import windows as WN
from postloom.plans.q_profile import event_posts
from postloom.plans.registry import query, table
from postloom.plans.views import posts, with_posts

# Events stand in for a generation ledger: one event = one generation.
MODEL_OF_EVENT = {"view": "claude", "click": "gpt54_nano", "signup": "gpt41_mini", "purchase": "llama"}
MODE_OF_MODEL = {"claude": "batch", "llama": "free_tier"}


def _case(col: str, mapping: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE '{default}' END"


def _prices_sql() -> str:
    rows = ", ".join(f"('{m}', '{mo}', CAST({i} AS DOUBLE), CAST({o} AS DOUBLE))" for m, mo, i, o in config.PRICES)
    return f"(VALUES {rows}) AS pr(model, mode, input_per_m, output_per_m)"


LEDGER_SQL = f""", led0 AS (
  SELECT event_id, user_id AS run_id, ts, {_case('event_type', MODEL_OF_EVENT, 'mystery')} AS model,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
         CAST(round(value * 100) AS BIGINT) AS input_tokens,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS output_tokens FROM events),
 led1 AS (SELECT *, {_case('model', config.MODEL_PRICE_KEY, 'mystery')} AS price_model,
                 {_case('model', MODE_OF_MODEL, 'realtime')} AS mode FROM led0),
 ledger AS (SELECT l.*, CASE WHEN l.status = 'ok' THEN
      CAST(l.input_tokens AS DOUBLE) / 1000000.0 * coalesce(pr.input_per_m, CAST({config.DEFAULT_PRICE[0]} AS DOUBLE))
    + CAST(l.output_tokens AS DOUBLE) / 1000000.0 * coalesce(pr.output_per_m, CAST({config.DEFAULT_PRICE[1]} AS DOUBLE))
    ELSE CAST(0.0 AS DOUBLE) END AS cost_usd
   FROM led1 l LEFT JOIN {_prices_sql()} ON pr.model = l.price_model AND pr.mode = l.mode)
"""


def ledger(spark, d):
    ev = table(spark, d, "events")
    model = F.lit("mystery")
    for k, v in reversed(list(MODEL_OF_EVENT.items())):
        model = F.when(F.col("event_type") == k, F.lit(v)).otherwise(model)
    led = ev.select(
        "event_id", F.col("user_id").alias("run_id"), "ts", model.alias("model"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.round(F.col("value") * 100).cast("long").alias("input_tokens"),
        F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))
    pm = F.lit("mystery")
    for k, v in reversed(list(config.MODEL_PRICE_KEY.items())):
        pm = F.when(F.col("model") == k, F.lit(v)).otherwise(pm)
    mode = F.lit("realtime")
    for k, v in MODE_OF_MODEL.items():
        mode = F.when(F.col("model") == k, F.lit(v)).otherwise(mode)
    led = led.withColumn("price_model", pm).withColumn("mode", mode)
    led = LG.with_prices(led, spark, "price_model", mode_col="mode")
    c = LG.cost(F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m"))
    return led.withColumn("cost_usd", F.when(F.col("status") == "ok", c).otherwise(F.lit(0.0))).drop(
        "input_per_m", "output_per_m")


@query("price_lookup", "J13/G9", f"""WITH {LEDGER_SQL.lstrip(', ')}
SELECT event_id, model, price_model, round(cost_usd, 9) AS cost_usd FROM ledger""")
def price_lookup(spark, d):
    return ledger(spark, d).select("event_id", "model", "price_model", F.round("cost_usd", 9).alias("cost_usd"))


@query("cost_per_model", "A9", f"""WITH {LEDGER_SQL.lstrip(', ')}
SELECT model, CAST(count(*) AS BIGINT) AS total_generations, CAST(sum(input_tokens) AS BIGINT) AS total_input_tokens,
  CAST(sum(output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(input_tokens) + sum(output_tokens) AS BIGINT) AS total_tokens,
  CAST(round(sum(CAST(cost_usd AS DECIMAL(38,12))), 6) AS DOUBLE) AS total_cost_usd,
  round(CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE) / greatest(count(*), 1), 6) AS avg_cost_per_generation,
  round(CAST(sum(CAST(cost_usd AS DECIMAL(38,12))) AS DOUBLE) / greatest(count(*), 1) * 1000, 6) AS cost_per_1k_generations
FROM ledger GROUP BY model""")
def cost_per_model(spark, d):
    s = LG.cost_summary(ledger(spark, d))
    s = s.withColumn("total_cost_usd", F.round("total_cost_usd", 6).cast("double"))
    return s.select(*[F.round(c, 6).alias(c) if c in ("avg_cost_per_generation", "cost_per_1k_generations")
                      else F.col(c) for c in s.columns])


@query("batch_summary", "A10", f"""WITH {LEDGER_SQL.lstrip(', ')}
SELECT CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS success,
  CAST(count(*) FILTER (WHERE status <> 'ok') AS BIGINT) AS failure,
  CAST(round(sum(CASE WHEN status = 'ok' THEN CAST(cost_usd AS DECIMAL(38,12)) ELSE 0 END), 6) AS DOUBLE) AS total_cost_usd,
  round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS elapsed_s,
  round(count(*) FILTER (WHERE status = 'ok') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS posts_per_s
FROM ledger""")
def batch_summary(spark, d):
    s = LG.batch_summary(ledger(spark, d))
    return s.select("success", "failure", F.round("total_cost_usd", 6).cast("double").alias("total_cost_usd"),
                    *[F.round(c, 6).alias(c) for c in ("elapsed_s", "posts_per_s")])


@query("progress_ledger", "W3", f"""WITH {LEDGER_SQL.lstrip(', ')}
SELECT run_id, seq, event_id, CAST(cum_success AS BIGINT) AS cum_success, CAST(cum_failure AS BIGINT) AS cum_failure,
  CAST(round(cum_cost, 6) AS DOUBLE) AS cum_cost FROM (
  SELECT run_id, event_id,
    row_number() OVER w AS seq,
    sum(CASE WHEN status = 'ok' THEN 1 ELSE 0 END) OVER w AS cum_success,
    sum(CASE WHEN status = 'ok' THEN 0 ELSE 1 END) OVER w AS cum_failure,
    sum(CASE WHEN status = 'ok' THEN CAST(cost_usd AS DECIMAL(38,12)) ELSE 0 END) OVER w AS cum_cost
  FROM ledger WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE seq % 10 = 0""")
def progress_ledger(spark, d):
    p = LG.progress(ledger(spark, d), "run_id", ["ts", "event_id"])
    return p.select("run_id", "seq", "event_id", "cum_success", "cum_failure",
                    F.round("cum_cost", 6).cast("double").alias("cum_cost"))


BUDGET = 0.5  # low enough to stop the ledger of every test size part of the way


@query("budget_cap", "G13", f"""WITH {LEDGER_SQL.lstrip(', ')}
SELECT event_id, seq, CAST(round(cum_cost, 6) AS DOUBLE) AS cum_cost FROM (
  SELECT event_id, row_number() OVER w AS seq, sum(CAST(cost_usd AS DECIMAL(38,12))) OVER w AS cum_cost
  FROM ledger WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
WHERE cum_cost <= {BUDGET}""")
def budget_cap(spark, d):
    b = LG.within_budget(ledger(spark, d), ["ts", "event_id"], cap=BUDGET)
    return b.select("event_id", "seq", F.round("cum_cost", 6).cast("double").alias("cum_cost"))


RUNLOG_SQL = """, runlog AS (
  SELECT event_id AS run_id, CASE user_id % 3 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' ELSE 'bluesky' END AS platform,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN event_type = 'error' THEN 0 ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS posts, ts
  FROM events)
"""


def runlog(spark, d):
    ev = table(spark, d, "events")
    m = F.col("user_id") % 3
    return ev.select(
        F.col("event_id").alias("run_id"),
        F.when(m == 0, "twitter").when(m == 1, "reddit").otherwise("bluesky").alias("platform"),
        F.when(F.col("event_type") == "error", "failed").otherwise("ok").alias("status"),
        F.when(F.col("event_type") == "error", F.lit(0).cast("long"))
        .otherwise(F.get_json_object("props", "$.k").cast("long")).alias("posts"), "ts")


@query("run_stats", "A11/X5", f"""WITH {RUNLOG_SQL.lstrip(', ')}
SELECT platform, CAST(count(*) AS BIGINT) AS total_scrapes, CAST(count(*) FILTER (WHERE status = 'ok') AS BIGINT) AS successful,
  CAST(count(*) FILTER (WHERE status = 'failed') AS BIGINT) AS failed, CAST(sum(posts) AS BIGINT) AS total_posts
FROM runlog GROUP BY platform""")
def run_stats(spark, d):
    return runlog(spark, d).groupBy("platform").agg(
        F.count(F.lit(1)).alias("total_scrapes"),
        F.count(F.when(F.col("status") == "ok", 1)).alias("successful"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failed"),
        F.sum("posts").cast("long").alias("total_posts"))


@query("newest_per_query", "W1", """
SELECT event_id, platform, query, rn FROM (
  SELECT event_id, event_type AS platform, 'u' || CAST(user_id AS VARCHAR) AS query,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, CAST(event_id AS VARCHAR)) AS rn FROM events)
WHERE rn <= 5""")
def newest_per_query(spark, d):
    return WN.newest_per_key(event_posts(spark, d), ["platform", "query"], 5).select("event_id", "platform", "query", "rn")


@query("comments_per_thread", "W2", """
SELECT conv_id, turn, rn FROM (
  SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system')
WHERE rn <= 3""")
def comments_per_thread(spark, d):
    c = table(spark, d, "conversations").filter(F.col("role") != "system")
    return WN.first_per_key(c, ["conv_id"], 3, ["turn"]).select("conv_id", "turn", "rn")


@query("recent_posts", "L1/L2", with_posts("""
SELECT post_id, created_at FROM posts_v ORDER BY created_at DESC, post_id LIMIT 10"""))
def recent_posts(spark, d):
    return WN.most_recent(posts(spark, d), 10, "created_at", "post_id").select("post_id", "created_at")


PLATFORM_OF_EVENT = {"view": "twitter", "click": "reddit", "signup": "bluesky"}


def _rate_sql() -> str:
    parts = []
    for ev, plat in PLATFORM_OF_EVENT.items():
        mx, per = config.RATE_LIMITS[plat]
        pu = per * 1_000_000
        parts.append(f"""SELECT event_id, '{plat}' AS platform, ts,
   count(*) OVER w - 1 AS n_in_window, count(*) OVER w - 1 >= {mx} AS over_limit,
   CASE WHEN count(*) OVER w - 1 >= {mx} THEN {per} - (epoch_us(ts) - min(epoch_us(ts)) OVER w) / 1e6 ELSE 0.0 END AS wait_s
 FROM events WHERE event_type = '{ev}'
 WINDOW w AS (ORDER BY epoch_us(ts) RANGE BETWEEN {pu - 1} PRECEDING AND CURRENT ROW)""")
    return "SELECT event_id, platform, CAST(n_in_window AS BIGINT) AS n_in_window, over_limit, round(wait_s, 6) AS wait_s FROM (" \
        + "\nUNION ALL\n".join(parts) + ")"


@query("rate_audit", "W4", _rate_sql())
def rate_audit(spark, d):
    ev = table(spark, d, "events")
    plat = F.lit(None).cast("string")
    for k, v in PLATFORM_OF_EVENT.items():
        plat = F.when(F.col("event_type") == k, F.lit(v)).otherwise(plat)
    x = ev.select("event_id", plat.alias("platform"), "ts").filter(F.col("platform").isNotNull())
    out = WN.trailing_window_audit(x, "platform", "ts", config.RATE_LIMITS)
    return out.select("event_id", "platform", "n_in_window", "over_limit", F.round("wait_s", 6).alias("wait_s"))
