"""Queries: prompts, message layouts, prompt parsing, templates, generation
results and batch inference (G2-G12, S6, S7, S11, J14)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T
from postloom.functions.hashing import hash_hex
from postloom.operators import filters as FL
from postloom.operators import generation as GE
from postloom.operators import ledger as LG
from postloom.operators import prompts as PM
from postloom.operators import sampling as SA
from postloom.plans import sqlfrag as S
from postloom.plans.q_profile import P1_SQL
from postloom.plans.q_sampling import EXAMPLES_SQL, PLAN_SQL, SEED, _md5, examples_for_requests, request_plan_df
from postloom.plans.registry import query, table
from postloom.plans.views import posts, with_posts
from postloom.session import scratch_path
from postloom.sources import templates as TP

NL = "chr(10)"


def _tpl_sql() -> str:
    rows = ", ".join(f"({S.q(p)}, {S.q(sp)})" for p, sp, _, _ in TP.load_template_rows())
    return f", tpl AS (SELECT * FROM (VALUES {rows}) t(platform, system_prompt))\n"


def _sql_lit(s: str) -> str:
    return S.q(s)


BLOCK_SQL = f""", exo AS (SELECT e.request_id, p.text, {_md5(SEED, "'shuffle'", 'e.request_id', 'e.post_id')} AS h
        FROM ex e JOIN posts_v p ON p.platform = e.platform AND p.post_id = e.post_id),
 blk AS (SELECT request_id,
           string_agg({NL} || 'Example ' || CAST(rn AS VARCHAR) || ':' || {NL} || text || {NL}, '' ORDER BY rn) AS block,
           list(text ORDER BY rn) AS texts
         FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY h, text) AS rn FROM exo) GROUP BY request_id)
"""
BASE_SQL = PLAN_SQL + EXAMPLES_SQL + BLOCK_SQL + _tpl_sql()


def _examples(spark, d, plan):
    ex = examples_for_requests(spark, d, plan)
    p = posts(spark, d).select("platform", "post_id", "text")
    ex = ex.join(p, ["platform", "post_id"]).withColumn(
        "h", hash_hex(SEED, F.lit("shuffle"), "request_id", "post_id"))
    return PM.ordered_examples(ex)


def _prompt_base(spark, d):
    plan = request_plan_df(spark, d)
    ex = _examples(spark, d, plan)
    tpl = TP.templates(spark).select("platform", "system_prompt")
    # Templates are config-sized; a platform without one fails
    return plan.join(ex, "request_id", "left").join(F.broadcast(tpl), "platform", "left").withColumn(
        "status", F.when(F.col("system_prompt").isNull(), "failed").otherwise("ok"))


@query("prompt_single", "G3/J14", with_posts(BASE_SQL + f"""
, pr AS (SELECT pl.request_id, pl.platform, CASE WHEN t.system_prompt IS NULL THEN 'failed' ELSE 'ok' END AS status,
                t.system_prompt || {_sql_lit(PM.EXAMPLES_HEADER_SINGLE)} || b.block || {_sql_lit(PM.INSTRUCTION)} AS prompt
         FROM plan pl LEFT JOIN blk b USING (request_id) LEFT JOIN tpl t USING (platform))
SELECT request_id, platform, status, md5(prompt) AS prompt_md5, CAST(length(prompt) AS BIGINT) AS prompt_len FROM pr"""))
def prompt_single(spark, d):
    b = _prompt_base(spark, d)
    p = PM.single_prompt(F.col("system_prompt"), F.col("examples"))
    return b.select("request_id", "platform", "status", F.md5(p).alias("prompt_md5"),
                    F.length(p).cast("long").alias("prompt_len"))


@query("prompt_pair", "G2", with_posts(BASE_SQL + f"""
SELECT pl.request_id, md5(t.system_prompt) AS system_md5,
  md5({_sql_lit(PM.EXAMPLES_HEADER_PAIR)} || b.block || {_sql_lit(PM.INSTRUCTION)}) AS user_md5
FROM plan pl LEFT JOIN blk b USING (request_id) LEFT JOIN tpl t USING (platform)"""))
def prompt_pair(spark, d):
    b = _prompt_base(spark, d)
    pair = PM.message_pair(F.col("system_prompt"), F.col("examples"))
    return b.select("request_id", F.md5(pair["system"]).alias("system_md5"), F.md5(pair["user"]).alias("user_md5"))


@query("prompt_messages", "G4", with_posts(BASE_SQL + f"""
SELECT pl.request_id, CAST(len(b.texts) + 1 AS BIGINT) AS n_messages,
  md5(array_to_string(list_transform(b.texts || [{_sql_lit(PM.MESSAGE_INSTRUCTION)}], lambda x: 'user:' || x), chr(1))) AS contents_md5
FROM plan pl JOIN blk b USING (request_id)"""))
def prompt_messages(spark, d):
    b = _prompt_base(spark, d).filter(F.col("examples").isNotNull())
    m = PM.chat_messages(F.col("examples"))
    flat = F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"), x["content"])), "\u0001")
    return b.select("request_id", F.size(m).cast("long").alias("n_messages"), F.md5(flat).alias("contents_md5"))


@query("prompt_layout", "G6", with_posts(BASE_SQL + f"""
SELECT pl.request_id, pl.model,
  CASE WHEN pl.model = 'claude' THEN 'messages' WHEN pl.model IN ({', '.join(S.q(m) for m in config.AZURE_MODELS)}) THEN 'pair'
       ELSE 'single' END AS kind,
  CASE WHEN pl.model = 'claude' THEN CAST(len(b.texts) + 1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS n_messages,
  CASE WHEN pl.model IN ({', '.join(S.q(m) for m in config.AZURE_MODELS)})
       THEN md5({_sql_lit(PM.EXAMPLES_HEADER_PAIR)} || b.block || {_sql_lit(PM.INSTRUCTION)}) END AS user_md5,
  CASE WHEN pl.model NOT IN ('claude', {', '.join(S.q(m) for m in config.AZURE_MODELS)})
       THEN md5(t.system_prompt || {_sql_lit(PM.EXAMPLES_HEADER_SINGLE)} || b.block || {_sql_lit(PM.INSTRUCTION)}) END AS prompt_md5
FROM plan pl LEFT JOIN blk b USING (request_id) LEFT JOIN tpl t USING (platform)"""))
def prompt_layout(spark, d):
    b = _prompt_base(spark, d)
    lay = PM.layout(F.col("model"), F.col("system_prompt"), F.col("examples"))
    b = b.withColumn("m", lay)
    kind = (F.when(F.col("model") == "claude", "messages").when(F.col("model").isin(*config.AZURE_MODELS), "pair")
            .otherwise("single"))
    return b.select("request_id", "model", kind.alias("kind"), F.size("m.messages").cast("long").alias("n_messages"),
                    F.md5("m.user").alias("user_md5"), F.md5("m.prompt").alias("prompt_md5"))


CONV_PROMPT_SQL = """, cp AS (SELECT conv_id, turn,
    CASE role WHEN 'system' THEN 'System: ' ELSE '' END || text
    || CASE WHEN lead(role) OVER w = 'user' THEN chr(10) || chr(10) || 'User: ' || lead(text) OVER w ELSE '' END AS prompt
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
"""


@query("parse_prompt", "G7", f"""WITH {CONV_PROMPT_SQL.lstrip(', ')}
SELECT conv_id, turn,
  CASE WHEN contains(prompt, 'System:') AND contains(prompt, 'User:') THEN 2 ELSE 1 END AS n_messages,
  CASE WHEN contains(prompt, 'System:') AND contains(prompt, 'User:')
       THEN {S.strip("replace(substr(prompt, 1, strpos(prompt, 'User:') - 1), 'System:', '')")} END AS system_content,
  CASE WHEN contains(prompt, 'System:') AND contains(prompt, 'User:')
       THEN {S.strip("substr(prompt, strpos(prompt, 'User:') + 5)")} ELSE prompt END AS user_content
FROM cp""")
def parse_prompt(spark, d):
    c = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    nxt_role, nxt_text = F.lead("role").over(w), F.lead("text").over(w)
    prompt = F.concat(F.when(F.col("role") == "system", "System: ").otherwise(""), F.col("text"),
                      F.when(nxt_role == "user", F.concat(F.lit("\n\nUser: "), nxt_text)).otherwise(""))
    msgs = PM.parse_prompt(prompt)
    x = c.select("conv_id", "turn", msgs.alias("m"))
    two = F.size("m") == 2
    return x.select("conv_id", "turn", F.size("m").alias("n_messages"),
                    F.when(two, F.col("m")[0]["content"]).alias("system_content"),
                    F.element_at("m", -1)["content"].alias("user_content"))


@query("platform_templates", "G5/R1/S6", with_posts(_tpl_sql() + f"""
, pool AS (SELECT platform, post_id, text FROM posts_v WHERE {P1_SQL}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {_md5('12', 'post_id')}, post_id) AS rn FROM pool),
 ex AS (SELECT platform, string_agg('Example ' || CAST(rn AS VARCHAR) || ':' || {NL} || text || {NL} || {NL}, '' ORDER BY rn) AS block,
               count(*) AS n FROM rk WHERE rn <= {config.SAMPLES_PER_PROMPT} GROUP BY platform)
SELECT t.platform, CAST(ex.n AS INT) AS num_examples, md5(t.system_prompt) AS system_md5,
  md5({_sql_lit(PM.TEMPLATE_HEADER)} || ex.block || {_sql_lit(PM.TEMPLATE_FOOTER)}) AS template_md5
FROM tpl t JOIN ex USING (platform)"""))
def platform_templates(spark, d):
    pool = FL.pool_filter_sql(posts(spark, d))
    k = SA.random_k(pool, config.SAMPLES_PER_PROMPT, "12")
    ex = k.groupBy("platform").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]).alias("examples"))
    # The template file read by Spark, here from shared storage
    path = scratch_path(spark, "templates")
    spark.createDataFrame([("\ufeff" + json.dumps(TP.load_document()),)], "value string").coalesce(1).write.text(path)
    j = TP.read_templates(spark, path).join(ex, "platform")
    return j.select("platform", F.size("examples").alias("num_examples"), F.md5("system_prompt").alias("system_md5"),
                    F.md5(PM.platform_template(F.col("system_prompt"), F.col("examples"))).alias("template_md5"))


@query("template_export", "S11", with_posts(_tpl_sql() + f"""
, pool AS (SELECT platform, post_id, text FROM posts_v WHERE {P1_SQL}),
 rk AS (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY {_md5('12', 'post_id')}, post_id) AS rn FROM pool),
 ex AS (SELECT platform, string_agg('Example ' || CAST(rn AS VARCHAR) || ':' || {NL} || text || {NL} || {NL}, '' ORDER BY rn) AS block,
               count(*) AS n FROM rk WHERE rn <= {config.SAMPLES_PER_PROMPT} GROUP BY platform),
 t AS (SELECT t.platform, '{{"platform":' || to_json(t.platform) || ',"system_prompt":' || to_json(t.system_prompt) || ',"user_prompt_template":'
          || to_json({_sql_lit(PM.TEMPLATE_HEADER)} || ex.block || {_sql_lit(PM.TEMPLATE_FOOTER)}) || ',"num_examples":' || ex.n || '}}' AS body
       FROM tpl t JOIN ex USING (platform))
SELECT '{{"metadata":{{"generated_at":"2026-01-01T00:00:00","samples_per_prompt":{config.SAMPLES_PER_PROMPT},"platforms":['
  || string_agg(to_json(platform), ',' ORDER BY platform) || ']}},"templates":{{'
  || string_agg(to_json(platform) || ':' || body, ',' ORDER BY platform) || '}}}}' AS value FROM t"""))
def template_export(spark, d):
    pool = FL.pool_filter_sql(posts(spark, d))
    k = SA.random_k(pool, config.SAMPLES_PER_PROMPT, "12")
    ex = k.groupBy("platform").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: x["text"]).alias("examples"))
    tpl = TP.templates(spark).drop("num_examples", "user_prompt_template").join(ex, "platform").select(
        "platform", "system_prompt", F.size("examples").alias("num_examples"),
        PM.platform_template(F.col("system_prompt"), F.col("examples")).alias("user_prompt_template"))
    return TP.export_templates(tpl, config.SAMPLES_PER_PROMPT, "2026-01-01T00:00:00")


GEN_AT = dt.datetime(2026, 1, 1)


@query("result_rows", "G10/G11/P10/S7", with_posts(PLAN_SQL + f"""
, gen AS (SELECT pl.request_id, pl.platform, pl.model,
    CASE WHEN pl.request_id % 11 = 0 THEN NULL ELSE '  ' || p.text || {NL} END AS text,
    CASE WHEN pl.model = 'llama' THEN NULL ELSE pl.model || '-family' END AS model_family,
    CASE WHEN pl.request_id % 5 = 0 THEN NULL ELSE CAST(length(p.text) // 3 AS BIGINT) END AS actual_out
  FROM plan pl JOIN posts_v p ON p.post_id = CAST(pl.request_id AS VARCHAR))
SELECT request_id, platform, {S.strip('text')} AS text, model, coalesce(model_family, model) AS model_family,
  CAST(length({S.strip('text')}) AS BIGINT) AS text_length,
  coalesce(actual_out, CAST(length(text) // 4 AS BIGINT)) AS output_tokens, 1 AS is_synthetic
FROM gen WHERE text IS NOT NULL"""))
def result_rows(spark, d):
    plan = request_plan_df(spark, d)
    p = posts(spark, d).select(F.col("post_id").cast("long").alias("request_id"), F.col("text").alias("ptext"))
    g = plan.join(p, "request_id").select(
        "request_id", "platform", "model",
        F.when(F.col("request_id") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("  "), F.col("ptext"), F.lit("\n"))).alias("text"),
        F.when(F.col("model") == "llama", F.lit(None).cast("string"))
        .otherwise(F.concat(F.col("model"), F.lit("-family"))).alias("model_family"),
        F.when(F.col("request_id") % 5 == 0, F.lit(None).cast("long"))
        .otherwise(F.floor(F.length("ptext") / 3).cast("long")).alias("actual_out"))
    g = g.withColumn("output_tokens", LG.tokens_or_estimate(F.col("actual_out"), F.col("text")))
    g = g.withColumn("cost_usd", F.lit(None).cast("double")).withColumn("input_tokens", F.lit(None).cast("long"))
    g = g.withColumn("generated_at", F.lit(GEN_AT.isoformat(sep=" ")).cast("timestamp_ntz"))
    r = LG.result_rows(g, keep=["request_id"])
    return r.select("request_id", "platform", "text", "model", "model_family", "text_length", "output_tokens",
                    "is_synthetic")


@query("generation_ledger", "P10/A10/G11", with_posts(PLAN_SQL + """
SELECT CAST(count(*) FILTER (WHERE request_id % 11 <> 0) AS BIGINT) AS success, CAST(count(*) FILTER (WHERE request_id % 11 = 0) AS BIGINT) AS failure
FROM plan"""))
def generation_ledger(spark, d):
    """Failed generations stay in the ledger: the batch summary counts them."""
    gen = request_plan_df(spark, d).select(
        "request_id", F.when(F.col("request_id") % 11 != 0, F.concat(F.lit("post "), F.col("platform"))).alias("text"),
        F.lit(0.0).alias("cost_usd"), F.lit(GEN_AT.isoformat(sep=" ")).cast("timestamp_ntz").alias("generated_at"))
    return LG.batch_summary(LG.with_status(gen), ts="generated_at").select("success", "failure")


def _stub_generate(row: dict, attempt: int) -> dict:
    """Stand-in for a model client (no network here): answers with the length
    of the prompt it was given; request ids divisible by 7 fail on their first
    attempt, ids divisible by 101 always fail."""
    rid = int(row["request_id"])
    if rid % 101 == 0:
        raise RuntimeError("upstream rejected the request")
    if rid % 7 == 0 and attempt == 1:
        raise TimeoutError("transient timeout")
    prompt = row["prompt"] or ""
    text = f"post for {row['platform']} after {len(prompt)} prompt characters"
    return {"text": text, "input_tokens": len(prompt) // 4, "output_tokens": len(text) // 4}


def _prices_sql() -> str:
    price = {m: (i, o) for m, mode, i, o in config.PRICES if mode == "realtime"}
    rows = ", ".join(f"('{k}', CAST({price.get(v, config.DEFAULT_PRICE)[0]} AS DOUBLE), CAST({price.get(v, config.DEFAULT_PRICE)[1]} AS DOUBLE))"
                     for k, v in config.MODEL_PRICE_KEY.items())
    return f"(VALUES {rows}) AS pr(model, input_per_m, output_per_m)"


@query("batch_inference", "G12/G9/P10", with_posts(BASE_SQL + f"""
, pr AS (SELECT pl.request_id, pl.platform, pl.model, length(t.system_prompt || {_sql_lit(PM.EXAMPLES_HEADER_SINGLE)} || b.block || {_sql_lit(PM.INSTRUCTION)}) AS n
         FROM plan pl LEFT JOIN blk b USING (request_id) LEFT JOIN tpl t USING (platform)),
 res AS (SELECT *, CASE WHEN n IS NULL OR request_id % 101 = 0 THEN 'failed' ELSE 'ok' END AS status,
           CAST(CASE WHEN n IS NULL THEN 0 WHEN request_id % 101 = 0 THEN 3 WHEN request_id % 7 = 0 THEN 2 ELSE 1 END AS INT) AS attempts,
           CASE WHEN n IS NULL THEN 'prompt is missing' WHEN request_id % 101 = 0 THEN 'RuntimeError: upstream rejected the request' END AS error,
           length('post for ' || platform || ' after ' || n || ' prompt characters') AS len FROM pr)
SELECT request_id, platform, r.model, status, attempts, error, CASE WHEN status = 'ok' THEN CAST(len AS BIGINT) END AS text_length,
  CASE WHEN status = 'ok' THEN round(CAST(n // 4 AS DOUBLE) / 1000000 * coalesce(pr.input_per_m, {config.DEFAULT_PRICE[0]})
                               + CAST(len // 4 AS DOUBLE) / 1000000 * coalesce(pr.output_per_m, {config.DEFAULT_PRICE[1]}), 9) END AS cost_usd
FROM res r LEFT JOIN {_prices_sql()} ON pr.model = r.model"""))
def batch_inference(spark, d):
    # every request stays: one without a template is a failed row, not a lost one
    req = _prompt_base(spark, d).select("request_id", "platform", "model",
                                        PM.single_prompt(F.col("system_prompt"), F.col("examples")).alias("prompt"))
    res = GE.batch_generate(req, _stub_generate, attempts=3, keep=["request_id", "platform", "model", "prompt"], needs=["prompt"])
    pm = F.lit("mystery")
    for k, v in reversed(list(config.MODEL_PRICE_KEY.items())):
        pm = F.when(F.col("model") == k, F.lit(v)).otherwise(pm)
    res = LG.with_prices(res.withColumn("price_model", pm), spark, "price_model")
    res = res.withColumn("cost_usd", F.when(F.col("status") == "ok", LG.cost(
        F.col("input_tokens"), F.col("output_tokens"), F.col("input_per_m"), F.col("output_per_m"))))
    return res.select("request_id", "platform", "model", "status", "attempts", "error",
                      F.length("text").cast("long").alias("text_length"), F.round("cost_usd", 9).alias("cost_usd"))
