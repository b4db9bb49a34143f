"""Generation cost ledger: prices, token estimates, cost, per-model summary,
batch summary, running totals, budget stop (G8-G13, A9, A10, A11, W3).

Running totals are computed in two phases so that no window spans a whole run,
a whole hour or the whole ledger: the rows are cut into blocks of bounded size
along the ledger order, and each block's offset comes from the block sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom import config
from postloom.functions import text as T
from postloom.session import materialize


# Money is summed as DECIMAL: exact, so totals do not depend on summation order
# (which differs between a partial aggregate and a sequential scan).
MONEY = "decimal(38,12)"


def money(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


def price_table(spark: SparkSession) -> DataFrame:
    """(model, mode, input_per_m, output_per_m) from configuration (closed set)."""
    return spark.createDataFrame(config.PRICES, "model string, mode string, input_per_m double, output_per_m double")


def with_prices(ledger: DataFrame, spark: SparkSession, model_col: str = "price_model", mode: str = "realtime",
                mode_col: str | None = None) -> DataFrame:
    """Left lookup of the price row; unknown models get the default price.
    The price table is config-sized, so broadcasting it is bounded."""
    p = price_table(spark)
    if mode_col is None:
        p = p.filter(F.col("mode") == mode).drop("mode")
        keys = [model_col]
        p = p.withColumnRenamed("model", model_col)
    else:
        p = p.withColumnRenamed("model", model_col).withColumnRenamed("mode", mode_col)
        keys = [model_col, mode_col]
    j = ledger.join(F.broadcast(p), keys, "left")
    return j.withColumn("input_per_m", F.coalesce("input_per_m", F.lit(config.DEFAULT_PRICE[0]))).withColumn(
        "output_per_m", F.coalesce("output_per_m", F.lit(config.DEFAULT_PRICE[1])))


def cost(input_tokens: Column, output_tokens: Column, input_per_m: Column, output_per_m: Column) -> Column:
    """in/1e6 * price_in + out/1e6 * price_out."""
    return input_tokens / 1_000_000 * input_per_m + output_tokens / 1_000_000 * output_per_m


def tokens_or_estimate(actual: Column, text: Column) -> Column:
    """The reported usage, else characters div 4."""
    return F.coalesce(actual.cast("long"), T.token_estimate(text))


def with_status(gen: DataFrame) -> DataFrame:
    """P10: every generation with ``status``: one without text is failed, and stays in the ledger."""
    return gen.withColumn("status", F.when(F.col("text").isNotNull(), "ok").otherwise("failed"))


def result_rows(gen: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The posts among the generations (those with text; ``with_status`` keeps the others in
    the ledger): strip the text, defaults for
    family/cost/tokens, ``text_length`` and ``is_synthetic`` (S7 columns);
    ``keep`` columns pass through."""
    g = gen.filter(F.col("text").isNotNull())
    text = T.unicode_strip("text")
    return g.select(
        *(keep or []), "platform", text.alias("text"), "model",
        F.coalesce(F.col("model_family"), F.col("model")).alias("model_family"),
        F.coalesce(F.col("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.col("input_tokens"), F.lit(0)).cast("long").alias("input_tokens"),
        F.coalesce(F.col("output_tokens"), F.lit(0)).cast("long").alias("output_tokens"),
        "generated_at",
        F.length(text).cast("long").alias("text_length"),
        F.lit(1).alias("is_synthetic"),
    )


def cost_summary(ledger: DataFrame, key: str = "model") -> DataFrame:
    """Generations, token sums, total and average cost, cost per 1000."""
    g = ledger.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_generations"),
        F.sum("input_tokens").cast("long").alias("total_input_tokens"),
        F.sum("output_tokens").cast("long").alias("total_output_tokens"),
        F.sum(money("cost_usd")).alias("total_cost_usd"))
    avg = F.col("total_cost_usd").cast("double") / F.greatest(F.col("total_generations"), F.lit(1))
    return g.select(
        key, "total_generations", "total_input_tokens", "total_output_tokens",
        (F.col("total_input_tokens") + F.col("total_output_tokens")).alias("total_tokens"),
        "total_cost_usd", avg.alias("avg_cost_per_generation"),
        (avg * 1000).alias("cost_per_1k_generations"))


def batch_summary(ledger: DataFrame, ts: str = "ts", status: str = "status") -> DataFrame:
    """A10: successes, failures, total cost, elapsed seconds, successes per second."""
    ok = F.col(status) == "ok"
    g = ledger.agg(
        F.count(F.when(ok, 1)).alias("success"),
        F.count(F.when(~ok, 1)).alias("failure"),
        F.sum(F.when(ok, money("cost_usd")).otherwise(F.lit(0).cast(MONEY))).alias("total_cost_usd"),
        F.min(ts).alias("__t0"), F.max(ts).alias("__t1"))
    elapsed = (F.unix_micros(F.col("__t1").cast("timestamp")) - F.unix_micros(F.col("__t0").cast("timestamp"))) / 1e6
    return g.select("success", "failure", "total_cost_usd", elapsed.alias("elapsed_s")).withColumn(
        "posts_per_s", F.try_divide(F.col("success").cast("double"), F.col("elapsed_s")))


BLOCK_ROWS = 100_000  # rows of a sub-block in running totals


def running_totals(df: DataFrame, part: list[str], order: list[str], sums: dict[str, Column], rows: int = BLOCK_ROWS,
                   partitions: int | None = None) -> DataFrame:
    """Cumulative sums (and the 1-based sequence ``seq``) per ``part`` in ``order``.

    A prefix scan of two levels.  The rows are range-partitioned by (part, order) into ``partitions``
    ranges (by default as many as any other shuffle has, whatever the number of rows) and stored in
    order, so that each row knows its range and its place in it; ``rows`` consecutive places make a
    sub-block.  Three small tables of sums give the offsets: sub-blocks are scanned inside their
    range, ranges inside their part (``partitions`` rows of a part at most, so not even one part for
    all rows makes a long scan), and a running sum inside each sub-block adds to both.  A run that
    holds all rows is spread over all ranges.  ``order`` should be unique within a part; a NULL
    part is a part."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = df
    for name, expr in sums.items():
        x = x.withColumn(f"__v_{name}", expr)
    vals = [f"__v_{name}" for name in sums]
    place = F.monotonically_increasing_id()  # the range's number, and the place in the range in its lower 33 bits
    x = x.repartitionByRange(n, *part, *order).sortWithinPartitions(*part, *order).withColumn("__at", place)
    x = materialize(x, "running-totals").withColumn("__range", F.shiftright("__at", 33)).withColumn(
        "__block", F.floor(F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) / rows))
    total = [F.sum(v).alias(v) for v in vals]
    blocks = materialize(x.groupBy(*part, "__range", "__block").agg(F.count(F.lit(1)).alias("__n"), *total), "block-sums")
    ranges = blocks.groupBy(*part, "__range").agg(F.sum("__n").alias("__n"), *total)

    def before(w, c: str) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inside = Window.partitionBy(*part, "__range").orderBy("__block")
    across = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy("__range")
    low = blocks.select(*part, "__range", "__block", *[before(inside, c).alias(f"{c}_in") for c in ("__n", *vals)])
    high = ranges.select(*part, "__range", *[before(across, c).alias(f"{c}_over") for c in ("__n", *vals)])

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        named = right.select(*[F.col(c).alias(f"__m_{c}") if c in on else F.col(c) for c in right.columns])
        return left.join(named, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in on]).drop(*[f"__m_{c}" for c in on])

    offsets = meet(low, high, [*part, "__range"])
    wi = Window.partitionBy(*part, "__range", "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, 0)
    inner = x.select("*", F.row_number().over(Window.partitionBy(*part, "__range", "__block").orderBy("__at")).alias("__rn"),
                     *[F.sum(v).over(wi).alias(f"{v}_run") for v in vals])
    out = meet(inner, offsets, [*part, "__range", "__block"])
    return out.select(*df.columns, (F.col("__n_over") + F.col("__n_in") + F.col("__rn")).alias("seq"),
                      *[(F.col(f"__v_{k}_over") + F.col(f"__v_{k}_in") + F.col(f"__v_{k}_run")).alias(k) for k in sums])


def progress(ledger: DataFrame, run: str, order: list[str], every: int = 10,
             status: str = "status", cost_col: str = "cost_usd") -> DataFrame:
    """Cumulative successes, failures and cost per run, reported on every
    ``every``-th row of the run."""
    ok = F.col(status) == "ok"
    r = running_totals(ledger, [run], order, {
        "cum_success": F.when(ok, 1).otherwise(0).cast("long"),
        "cum_failure": F.when(ok, 0).otherwise(1).cast("long"),
        "cum_cost": F.when(ok, money(cost_col)).otherwise(F.lit(0).cast(MONEY)),
    })
    return r.filter(F.col("seq") % every == 0)


def within_budget(ledger: DataFrame, order: list[str], cap: float = config.MAX_BUDGET_USD,
                  cost_col: str = "cost_usd", part: list[str] | None = None) -> DataFrame:
    """Rows processed before the cumulative cost passes ``cap``."""
    r = running_totals(ledger, part or [], order, {"cum_cost": money(cost_col)})
    return r.filter(F.col("cum_cost") <= cap)
