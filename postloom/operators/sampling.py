"""Seeded, reproducible sampling and assignment.

Randomness is ``md5(seed|key)`` (see ``functions.hashing``), so every sample
is a deterministic function of the data and has a SQL oracle.

Scale notes
-----------
* An exact split finds its two boundary rows and compares every row with them;
  no row moves.
* Global ranks never use a single-partition window.  ``exact_rank`` is a
  two-phase rank: count rows per hash-prefix block (at most ``16**width`` rows
  per partition key), prefix-sum those counts on the small table, then
  ``row_number`` inside each block plus the block offset.  A platform holding a
  third of all rows is spread over ``16**width`` blocks.
* Per-group top-k uses ``row_number() <= k`` with a literal ``k``, which Spark
  plans as ``WindowGroupLimit``: each task keeps k rows per group before the
  shuffle, so a hot group ships k rows per task, not its whole size.
* Assigning examples to many requests is an equi-join on (platform, bucket,
  slot index), never requests x pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom import config
from postloom.functions.hashing import hash_hex, u32, unit


def exact_rank(df: DataFrame, partition: list[str], seed: str, keys: list[str], width: int = 4,
               rank_col: str = "rank", size_col: str | None = None, ties: list[str] | None = None) -> DataFrame:
    """0-based rank of each row inside ``partition`` by (md5(seed|keys), keys, ``ties``),
    without a window over a whole partition.  Optionally adds the partition size."""
    h = hash_hex(seed, *keys)
    x = df.withColumn("__h", h).withColumn("__blk", F.conv(F.substring("__h", 1, width), 16, 10).cast("long"))
    blocks = x.groupBy(*partition, "__blk").agg(F.count(F.lit(1)).alias("__cnt"))
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    blocks = blocks.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(w.orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if size_col:
        blocks = blocks.withColumn(size_col, F.sum("__cnt").over(w))
    inner = Window.partitionBy(*partition, "__blk").orderBy("__h", *keys, *(ties or []))
    ranked = x.withColumn("__rn", F.row_number().over(inner)).join(
        blocks.drop("__cnt"), [*partition, "__blk"])
    out = ranked.withColumn(rank_col, F.col("__off") + F.col("__rn") - 1)
    return out.drop("__h", "__blk", "__rn", "__off")


def split_sizes(n: Column) -> tuple[Column, Column]:
    """(train, val) sizes of a 70/15/15 split: test share ceil(0.3 n), then the
    rest halved with the larger half to test."""
    rest = (F.lit(3) * n + 9).cast("long") / 10
    n_rest = F.floor(rest).cast("long")
    train = n - n_rest
    val = n_rest - F.floor((n_rest + 1) / 2).cast("long")
    return train, val


def split_exact(df: DataFrame, keys: list[str], seed: str = str(config.SPLIT_SEED), width: int = 4) -> DataFrame:
    """Exact 70/15/15 assignment by hash rank; adds ``split_group``.

    An exact split needs only the two rows at which a new group begins.  Their blocks come from
    the block counts, their keys from a rank inside these (two at most), and every row is then
    compared with them where it lies: the rows themselves are not shuffled.  ``keys`` are unique."""
    h = hash_hex(seed, *keys)
    slim = df.select(*keys, h.alias("__h")).withColumn("__blk", F.substring("__h", 1, width))
    blocks = slim.groupBy("__blk").agg(F.count(F.lit(1)).alias("__cnt"))  # 16**width rows at most
    w = Window.partitionBy(F.lit(0))
    blocks = blocks.withColumn("__n", F.sum("__cnt").over(w)).withColumn(
        "__off", F.sum("__cnt").over(w.orderBy("__blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__cnt"))
    train, val = split_sizes(F.col("__n"))
    begin = F.explode(F.array(F.struct(F.lit("val").alias("g"), train.alias("at")), F.struct(F.lit("test").alias("g"), (train + val).alias("at"))))
    starts = blocks.select("__blk", "__off", "__cnt", begin.alias("s")).where("s.at >= __off AND s.at < __off + __cnt").select(
        "__blk", "s.g", (F.col("s.at") - F.col("__off") + 1).alias("__nth"))
    ranked = slim.join(F.broadcast(starts.select("__blk").distinct()), "__blk").withColumn(
        "__rn", F.row_number().over(Window.partitionBy("__blk").orderBy("__h", *keys)))
    found = ranked.join(F.broadcast(starts), "__blk").where("__rn = __nth")
    first = lambda g: F.max(F.when(F.col("g") == g, F.struct("__h", *keys)))
    bounds = found.agg(F.struct(first("val").alias("val"), first("test").alias("test"))).scalar()
    here = F.struct(h.alias("__h"), *keys)
    g = (F.when(F.coalesce(here < F.col("__b")["val"], F.lit(True)), "train")
         .when(F.coalesce(here < F.col("__b")["test"], F.lit(True)), "val").otherwise("test"))
    return df.withColumn("__b", bounds).withColumn("split_group", g).drop("__b")


def top_k_per_group(df: DataFrame, group: list[str], k: int, order: list[Column], rn: str = "rn") -> DataFrame:
    """``row_number() <= k`` per group; literal k lets Spark plan WindowGroupLimit."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rn, F.row_number().over(w)).filter(F.col(rn) <= k).withColumn(rn, F.col(rn).cast("long"))


def random_k(pool: DataFrame, k: int, seed: str, key: str = "post_id", group: str = "platform") -> DataFrame:
    """K posts per platform in seeded hash order."""
    return top_k_per_group(pool, [group], k, [hash_hex(seed, key), F.col(key)])


def seeded_preview(pool: DataFrame, n: int, seed: str, key: str = "post_id") -> DataFrame:
    """min(n, size) rows in seeded order (TakeOrderedAndProject)."""
    return pool.orderBy(hash_hex(seed, key), F.col(key)).limit(n)


def sample_sketch(pool: DataFrame, k: int, seed: str, key: str = "post_id", group: str = "platform") -> DataFrame:
    """R1/R6, mergeable: the K rows of each group that come first in seeded hash order, with that hash as
    ``sample_hash``.  Sketches of the parts of a pool merge into the sketch of the whole."""
    hashed = pool.withColumn("sample_hash", hash_hex(seed, key))
    return top_k_per_group(hashed, [group], k, [F.col("sample_hash"), F.col(key)], "__rn").drop("__rn")


def merge_sketches(sketches: DataFrame, k: int, key: str = "post_id", group: str = "platform") -> DataFrame:
    """One sketch of the union of sketches made with one seed and ``k`` or more; a row that several hold counts once."""
    once = sketches.dropDuplicates([group, key])
    return top_k_per_group(once, [group], k, [F.col("sample_hash"), F.col(key)], "__rn").drop("__rn")


def length_bucket(platform: Column, length: Column, buckets: dict = config.LENGTH_BUCKETS) -> Column:
    """Bucket name by platform-specific length bounds; NULL outside all buckets."""
    def case(spec):
        e = None
        for name, lo, hi, _ in spec:
            cond = length.between(lo, hi)
            e = F.when(cond, F.lit(name)) if e is None else e.when(cond, F.lit(name))
        return e

    out = None
    for plat, spec in buckets.items():
        if plat == "default":
            continue
        out = F.when(platform == plat, case(spec)) if out is None else out.when(platform == plat, case(spec))
    default = case(buckets["default"])
    return default if out is None else out.otherwise(default)


def example_pool(posts: DataFrame, col: str = "text") -> DataFrame:
    """Posts usable as examples: text present, not blank for SQL ``TRIM``, no media."""
    t = F.col(col)
    return posts.filter(t.isNotNull() & (F.trim(t) != "") & ~F.coalesce(F.col("has_media"), F.lit(False)))


def stratified_sample(posts: DataFrame, n: int, seed: str, key: str = "post_id", col: str = "text") -> DataFrame:
    """R2 + R3 for every platform: ``n`` examples with short/medium quotas, long
    taking the remainder, then a fallback from any length for a shortfall
    (without replacement).  Adds ``bucket`` and the shuffled position ``pos``."""
    q_short, q_med = config.bucket_quotas(n)
    pool = example_pool(posts, col).withColumn("__len", F.length(col)).withColumn(
        "bucket", length_bucket(F.col("platform"), F.col("__len")))
    in_b = pool.filter(F.col("bucket").isNotNull())
    # quota <= n always, so a literal top-n per (platform, bucket) bounds the shuffle
    ranked = top_k_per_group(in_b, ["platform", "bucket"], n, [hash_hex(seed, F.lit("bucket"), key), F.col(key)])
    avail = ranked.groupBy("platform").agg(
        F.count(F.when(F.col("bucket") == "short", 1)).alias("a_s"),
        F.count(F.when(F.col("bucket") == "medium", 1)).alias("a_m"),
        F.count(F.when(F.col("bucket") == "long", 1)).alias("a_l"))
    quota = avail.select(
        "platform",
        F.least(F.lit(q_short), "a_s").alias("q_s"),
        F.least(F.lit(q_med), "a_m").alias("q_m"),
        F.col("a_l"))
    quota = quota.withColumn("q_l", F.least(F.lit(n) - F.col("q_s") - F.col("q_m"), F.col("a_l")))
    quota = quota.withColumn("got", F.col("q_s") + F.col("q_m") + F.col("q_l"))
    chosen = ranked.join(quota, "platform").filter(
        F.col("rn") <= F.when(F.col("bucket") == "short", F.col("q_s"))
        .when(F.col("bucket") == "medium", F.col("q_m")).otherwise(F.col("q_l")))
    chosen = chosen.select("platform", key, "bucket")
    # fallback: any length, not already chosen, second hash order, n - got rows
    need = posts.select("platform").distinct().join(quota.select("platform", "got"), "platform", "left").select(
        "platform", (F.lit(n) - F.coalesce(F.col("got"), F.lit(0))).alias("need"))
    rest = pool.join(chosen.select("platform", key), ["platform", key], "left_anti")
    fb = top_k_per_group(rest, ["platform"], n, [hash_hex(seed, F.lit("fallback"), key), F.col(key)])
    fb = fb.join(need, "platform").filter(F.col("rn") <= F.col("need")).select(
        "platform", key, F.lit("fallback").alias("bucket"))
    out = chosen.unionByName(fb)
    # shuffle: position by a third hash inside each platform (<= n rows per group)
    w = Window.partitionBy("platform").orderBy(hash_hex(seed, F.lit("shuffle"), key), F.col(key))
    return out.withColumn("pos", F.row_number().over(w).cast("long"))


def cdf_case(u: Column, weights: list[tuple[str, float]]) -> Column:
    """Pick the first entry whose cumulative weight exceeds ``u * total``;
    entries with weight 0 are inactive.  Config-sized, so a CASE expression."""
    active = [(k, w) for k, w in weights if w > 0]
    total = sum(w for _, w in active)
    cum, e = 0.0, None
    for k, w in active[:-1]:
        cum += w
        cond = u * F.lit(total) < F.lit(cum)
        e = F.when(cond, F.lit(k)) if e is None else e.when(cond, F.lit(k))
    last = F.lit(active[-1][0])
    return last if e is None else e.otherwise(last)


def choose_model(requests: DataFrame, seed: str, id_col: str = "request_id",
                 weights=config.MODEL_WEIGHTS) -> DataFrame:
    """Weighted model choice per request."""
    return requests.withColumn("model", cdf_case(unit(seed, F.lit("model"), id_col), weights))


def choose_platform(requests: DataFrame, counts: DataFrame, seed: str, id_col: str = "request_id") -> DataFrame:
    """Platform chosen proportionally to the valid-pool size of each platform.

    ``counts`` has one row (platform, n) per platform of the table, whichever it holds; they
    become one array with cumulative sizes (a scalar subquery), so no join is needed."""
    entries = F.sort_array(F.collect_list(F.struct("platform", F.col("n").cast("long").alias("n"))))
    sums = F.transform("e", lambda x, i: F.struct(x["platform"].alias("platform"), F.aggregate(
        F.slice("e", F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("hi")))
    cdf = counts.where("n > 0").agg(entries.alias("e")).select(sums.alias("c")).scalar()
    at = unit(seed, F.lit("platform"), id_col) * F.element_at("__cdf", -1)["hi"]
    x = requests.withColumn("__cdf", cdf).withColumn("__at", F.when(F.size("__cdf") > 0, at))
    return x.withColumn("platform", F.get(F.filter("__cdf", lambda c: F.col("__at") < c["hi"]), 0)["platform"]).drop("__cdf", "__at")


def model_family(model: Column) -> Column:
    return (F.when(model == "claude", "claude").when(model.isin(*config.AZURE_MODELS), "azure").otherwise("other"))


def request_plan(requests: DataFrame, counts: DataFrame, seed: str, id_col: str = "request_id") -> DataFrame:
    """G1: platform, model, example count (8..15) and temperature per request."""
    x = choose_platform(choose_model(requests, seed, id_col), counts, seed, id_col)
    span = config.MAX_EXAMPLES - config.MIN_EXAMPLES + 1
    x = x.withColumn("n_examples", (F.lit(config.MIN_EXAMPLES) + u32(seed, F.lit("n"), id_col) % span).cast("int"))
    fam = model_family(F.col("model"))
    lo = F.when(fam == "claude", config.TEMPERATURE_RANGES["claude"][0]).when(
        fam == "azure", config.TEMPERATURE_RANGES["azure"][0]).otherwise(config.TEMPERATURE_RANGES["other"][0])
    hi = F.when(fam == "claude", config.TEMPERATURE_RANGES["claude"][1]).when(
        fam == "azure", config.TEMPERATURE_RANGES["azure"][1]).otherwise(config.TEMPERATURE_RANGES["other"][1])
    return x.withColumn("temperature", lo + unit(seed, F.lit("temp"), id_col) * (hi - lo))


def request_examples(requests: DataFrame, posts: DataFrame, seed: str, key: str = "post_id",
                     col: str = "text", width: int = 4) -> DataFrame:
    """Examples for many requests at once by index joins: (request_id, platform, bucket, j, key).

    Each (platform, bucket) pool is ranked once (idx 0..B-1).  A request needing q rows of a
    bucket takes the slots j = 0..min(q, B)-1 at ``idx = (offset + j) mod B`` with ``offset =
    u32(request|bucket) mod B``: distinct rows inside a request, and an equi-join on (platform,
    bucket, idx).  Quotas follow R2 (short/medium shares, long takes the rest).

    A request that the buckets leave short is filled up from its platform's whole pool, any
    length (bucket ``fallback``): it walks min(n, pool) consecutive slots of a second rank from
    another offset, leaves out what it has, and takes the first that it needs.  So every request
    gets min(n_examples, pool) different posts.

    Only keys and buckets are ranked and joined; sizes come from the pool's counts.  Texts are
    left to the caller.  ``requests`` needs ``request_id``, ``platform``, ``n_examples``."""
    from postloom.session import materialize

    pool = materialize(example_pool(posts, col).select("platform", key, length_bucket(F.col("platform"), F.length(col)).alias("bucket")), "example-pool")
    ranked = exact_rank(pool.where("bucket is not null"), ["platform", "bucket"], seed, [key], width=width, rank_col="idx")
    anywhere = exact_rank(pool.drop("bucket"), ["platform"], f"{seed}-any", [key], width=width, rank_col="idx")
    count = lambda b: F.count(F.when(F.col("bucket") == b, 1))
    sizes = pool.groupBy("platform").agg(count("short").alias("B_s"), count("medium").alias("B_m"), count("long").alias("B_l"), F.count(F.lit(1)).alias("P"))
    n = F.col("n_examples")
    r = requests.select("request_id", "platform", "n_examples").join(sizes, "platform")
    q_s = F.least(F.greatest(F.lit(1), F.floor(n * 3 / 10).cast("long")), F.col("B_s"))
    q_m = F.least(F.greatest(F.lit(1), F.floor(n * 4 / 10).cast("long")), F.col("B_m"))
    # a request for fewer posts than the quotas' minimum takes no more than it asks for
    r = r.withColumn("q_s", F.least(q_s, n)).withColumn("q_m", F.least(q_m, n - F.col("q_s"))).withColumn("q_l", F.least(n - F.col("q_s") - F.col("q_m"), F.col("B_l")))
    r = r.withColumn("want", F.least(n.cast("long"), F.col("P"))).withColumn("need", F.col("want") - F.col("q_s") - F.col("q_m") - F.col("q_l"))

    def walk(x: DataFrame, q: str, size: str, bucket: Column) -> DataFrame:
        slots = x.where(F.col(q) > 0).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), (F.col(q) - 1).cast("long"))))
        return slots.withColumn("idx", (u32(seed, F.lit("offset"), "request_id", bucket) + F.col("j")) % F.col(size))

    per_bucket = r.select("request_id", "platform", F.explode(F.array(*[
        F.struct(F.lit(b).alias("bucket"), F.col(q).alias("q"), F.col(size).alias("B"))
        for b, q, size in (("short", "q_s", "B_s"), ("medium", "q_m", "B_m"), ("long", "q_l", "B_l"))])).alias("b")).select("request_id", "platform", "b.*")
    slots = walk(per_bucket, "q", "B", F.col("bucket"))
    chosen = slots.join(ranked, ["platform", "bucket", "idx"]).select("request_id", "platform", "bucket", "j", key)
    chosen = materialize(chosen, "bucket-examples")
    short = walk(r.where("need > 0"), "want", "P", F.lit("fallback")).join(anywhere, ["platform", "idx"]).select("request_id", "platform", "need", "j", key)
    fresh = short.join(chosen.select("request_id", key), ["request_id", key], "left_anti")
    order = Window.partitionBy("request_id").orderBy("j")  # MAX_EXAMPLES rows at most
    extra = fresh.withColumn("__rn", F.row_number().over(order)).where(F.col("__rn") <= F.col("need")).select(
        "request_id", "platform", F.lit("fallback").alias("bucket"), (F.col("__rn") - 1).cast("long").alias("j"), key)
    return chosen.unionByName(extra)
