"""Secret scans: pattern kinds plus a randomness test battery (DataFrame functions only).

Base kinds (leftmost, non-overlapping per kind):
  assign  a key word, = or :, and a value of 6 characters or more
  access  AKIA and capitals or digits, 20 characters or more
  hex     24 or more of 0-9a-f

Method: runs of 20 or more characters of ``[A-Za-z0-9+/_=-]`` that hold a digit, or a capital
after a small letter, are candidates (a run of letters in one case is taken for a word).  The
encoding of each is inferred from its characters (decimal, hex, base32, letters, base36, base64).  Three tests ask whether its symbols can be uniform over that alphabet:
chi-squared of the symbol counts, runs above and below the alphabet's middle, and serial
correlation of neighbours; the smallest p-value times three must reach ``ALPHA``.  Ordinary
text passes such tests when it is short, so discoveries are controlled separately: under the
null "written text" neighbouring characters change class (lower, upper, digit, other) with
probability 0.15 at most, which gives each candidate a p-value that shrinks with its length;
Benjamini-Hochberg at level ``FDR`` runs within each length class (powers of two).
The procedure needs only the histogram of p-values: 400 bins for each of at most 31 length
classes, whatever the corpus, so the thresholds are the only thing sent to every task.

Two passes over the texts, no shuffle of texts: the first builds the histogram, the second
finds all spans.  Positions are code points, end exclusive; they come from the pieces
between the matches, so they are right wherever a match lies.

Edge cases: null or empty text has no spans (base_sha256 of the empty string).  No candidate
at all gives no thresholds and no added span.  Rows are kept one to one (null or repeated
doc_id too); extra columns are ignored by ``find_secrets``, kept by ``scan`` and ``redact``,
and may bear any name that does not begin with ``_scan_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.columns import let, upto

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LIKELY = r"""(?i:passw|secret|token|api_?key)\w*["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a run of 20 or more; a shorter one has no longer match inside it
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_=-]*?(?:[0-9]|[a-z][A-Z]))[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
VALUE_CHARS = 6
ALPHA = 0.003
FDR = 0.01
CHANGE = 0.15
DIGIT_AGAIN = 0.5
BINS_PER_DECADE = 20
LAST_BIN = 399


def located(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """array<struct<start, end, s>> of all matches; ``wanted``: array<boolean> saying which to keep."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def walk(parts: Column) -> Column:  # the last piece has no match
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,s:string>>").alias("out"))

        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["p"])
            end = start + F.coalesce(F.length(x["m"]), F.lit(0))
            return F.struct(end.alias("at"), F.when(x["m"].isNull(), a["out"]).otherwise(
                F.concat(a["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("s"))))).alias("out"))

        return F.aggregate(parts, first, step, lambda a: a["out"])

    spans = walk(found)
    if wanted is not None:
        spans = let(wanted, lambda ok: F.filter(walk(found), lambda x, i: ok[i]))
    return spans


def _spans(text: Column, likely: str, kind: int, pattern: str, wanted: Column | None = None) -> Column:
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return F.when(text.rlike(likely), F.transform(located(text, pattern, wanted), lambda x: F.struct(
        x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))).otherwise(none)


def base_spans(text: Column) -> Column:
    long_enough = F.transform(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= VALUE_CHARS)
    return F.concat(_spans(text, ASSIGN_LIKELY, 0, ASSIGN, long_enough), _spans(text, ACCESS, 1, ACCESS), _spans(text, HEX, 2, HEX))


def upper_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal (rational approximation, absolute error below 7.5e-8 near
    the middle; the asymptotic series takes over above z = 4)."""
    def tail(x: Column) -> Column:
        t = 1 / (1 + 0.2316419 * x)
        density = F.exp(-x * x / 2) * 0.3989422804014327
        poly = let(t, lambda u: u * (0.319381530 + u * (-0.356563782 + u * (1.781477937 + u * (-1.821255978 + u * 1.330274429)))))
        return density * F.when(x > 4, (1 - 1 / (x * x) + 3 / (x * x * x * x)) / x).otherwise(poly)

    return let(z, lambda y: F.when(y >= 0, tail(F.abs(y))).otherwise(1 - tail(F.abs(y))))


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _encoding(s: Column) -> Column:
    """struct<body, alphabet>: the token without padding, in the inferred alphabet's own case and signs."""
    body = F.regexp_replace(s, "=+$", "")
    plain = F.translate(body, "-_", "+/")
    return let(plain, lambda b: F.struct(
        F.when(b.rlike("^[0-9A-F]+$"), F.lower(b)).otherwise(b).alias("body"),
        F.when(b.rlike("^[0-9]+$"), F.lit(DIGITS)).when(b.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(DIGITS + "abcdef"))
        .when(b.rlike("^[A-Za-z]+$"), F.lit(UPPER + LOWER)).when(b.rlike("^[A-Z2-7]+$"), F.lit(UPPER + "234567")).when(b.rlike("^[0-9a-z]+$"), F.lit(DIGITS + LOWER))
        .when(b.rlike("^[0-9A-Z]+$"), F.lit(DIGITS + UPPER)).otherwise(F.lit(UPPER + LOWER + DIGITS + "+/")).alias("alphabet")))


def battery(s: Column) -> Column:
    """struct<p_random, p_text, length>: the uniformity battery's corrected p-value and the
    p-value under written text, for one token."""

    def tests(e: Column) -> Column:
        symbols = F.filter(F.split(e["body"], ""), lambda c: F.length(c) > 0)
        values = F.transform(symbols, lambda c: F.instr(e["alphabet"], c).cast("double") - 1)  # -1: outside the alphabet
        return let(values, lambda v: sums(e, v))

    zero, add = F.lit(0.0), lambda a, x: a + x

    def sums(e: Column, v: Column) -> Column:
        m = F.length(e["alphabet"]).cast("double")
        high = F.transform(v, lambda x: (x >= m / 2).cast("double"))
        pairs = upto(F.size(v) - 1)
        counts = F.transform(F.array_distinct(v), lambda x: F.pow(F.size(F.filter(v, lambda y: y == x)).cast("double"), 2.0))
        first = F.struct(
            m.alias("m"), F.size(v).cast("double").alias("n"), F.aggregate(counts, zero, add).alias("squares"), F.aggregate(high, zero, add).alias("ones"),
            let(high, lambda h: F.aggregate(F.transform(pairs, lambda i: (h[i] != h[i + 1]).cast("double")), zero, add)).alias("changed"),
            F.aggregate(v, zero, add).alias("total"))
        return let(first, lambda c: moments(c, v))

    def moments(c: Column, v: Column) -> Column:
        mean = c["total"] / c["n"]
        lag = let(mean, lambda a: F.aggregate(F.transform(upto(F.size(v) - 1), lambda i: (v[i] - a) * (v[i + 1] - a)), zero, add))
        spread = let(mean, lambda a: F.aggregate(F.transform(v, lambda x: (x - a) * (x - a)), zero, add))
        runs = 2 * c["ones"] * (c["n"] - c["ones"]) / c["n"] + 1  # expected number of runs
        second = F.struct(c["m"].alias("m"), c["n"].alias("n"), c["squares"].alias("squares"), c["changed"].alias("changed"),
                          runs.alias("runs"), lag.alias("lag"), F.greatest(spread, F.lit(1e-9)).alias("spread"))
        return let(second, tests_of)

    def tests_of(c: Column) -> Column:
        n, df = c["n"], c["m"] - 1
        chi = F.greatest(c["squares"] * c["m"] / n - n, zero)
        z_chi = (F.pow(chi / df, 1 / 3.0) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        var = F.greatest((c["runs"] - 1) * (c["runs"] - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        z_runs = F.abs(c["changed"] + 1 - c["runs"]) / F.sqrt(var)
        z_serial = F.abs(c["lag"] / c["spread"] + 1 / n) * F.sqrt(n)
        return F.least(F.lit(1.0), 3 * F.least(upper_tail(z_chi), 2 * upper_tail(z_runs), 2 * upper_tail(z_serial)))

    classes = F.translate(s, LOWER + UPPER + DIGITS + "+/_=-", "a" * 26 + "A" * 26 + "0" * 10 + "+" * 5)
    changes = F.length(F.regexp_replace(F.regexp_replace(classes, r"(.)\1+", "$1"), "^.", "")).cast("double")
    n = F.length(s).cast("double") - 1
    p_text = F.when(classes.rlike("^0+$"), F.pow(F.lit(DIGIT_AGAIN), n)).otherwise(
        upper_tail((changes - 0.5 - n * CHANGE) / F.sqrt(n * CHANGE * (1 - CHANGE))))
    return F.struct(let(_encoding(s), tests).alias("p_random"), F.greatest(p_text, F.lit(1e-300)).alias("p_text"),
                    F.floor(F.log2(F.length(s).cast("double"))).cast("int").alias("size"))


def _candidates(text: Column) -> Column:
    """array<struct<start, end, p_random, size, bin>> of the tokens that the battery takes for random."""
    def judge(x: Column) -> Column:
        return let(battery(x["s"]), lambda b: F.struct(
            x["start"].alias("start"), x["end"].alias("end"), b["p_random"].alias("p_random"), b["size"].alias("size"),
            F.least(F.lit(LAST_BIN), F.greatest(F.lit(0), F.floor(-F.log10(b["p_text"]) * BINS_PER_DECADE))).cast("int").alias("bin")))

    none = F.array().cast("array<struct<start:int,end:int,p_random:double,size:int,bin:int>>")
    return F.when(text.rlike(CANDIDATE), F.transform(located(text, CANDIDATE), judge)).otherwise(none)


def thresholds(docs: DataFrame) -> DataFrame:
    """Per length class the lowest bin of -log10(p) that Benjamini-Hochberg accepts: (size, least).

    A bin stands for its largest p-value, so binning errs on the side of fewer discoveries."""
    each = docs.select(F.explode(_candidates(F.col("text").cast("string"))).alias("c")).select("c.size", "c.bin")
    counts = each.groupBy("size", "bin").agg(F.count("*").alias("n"))  # at most 31 * 400 rows
    per = counts.groupBy("size").agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("bins"))
    reached = F.transform(F.col("bins"), lambda x: F.struct(
        x["bin"].alias("bin"), F.aggregate(F.filter("bins", lambda y: y["bin"] >= x["bin"]), F.lit(0).cast("long"), lambda a, y: a + y["n"]).alias("m")))
    good = F.filter(reached, lambda x: F.pow(F.lit(10.0), -x["bin"].cast("double") / BINS_PER_DECADE) <= FDR * x["m"] / F.col("total"))
    return per.select("size", F.array_min(F.transform(good, lambda x: x["bin"])).alias("least")).where("least is not null")


def scan(docs: DataFrame, column: str = "spans") -> DataFrame:
    """The documents with ``column``: array<struct<start, kind, end>> by start, then kind."""
    # a scalar subquery: a map with one entry per length class (31 at most)
    limits = thresholds(docs).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("size", "least"))).alias("_scan_limits"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.withColumn("_scan_limits", limits.scalar()).withColumn("_scan_base", base_spans(text)).withColumn("_scan_more", _candidates(text))
    added = F.filter("_scan_more", lambda x: (x["p_random"] >= ALPHA) & (x["bin"] >= F.coalesce(F.col("_scan_limits")[x["size"]], F.lit(LAST_BIN + 1)))
                     & ~F.exists("_scan_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    spans = F.sort_array(F.concat("_scan_base", F.transform(added, lambda x: F.struct(
        x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")))))
    return found.withColumn(column, spans).drop("_scan_limits", "_scan_base", "_scan_more")


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every document."""
    scanned = scan(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return scanned.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                          F.sha2(spans_text(F.filter("spans", lambda x: x["kind"] < 3)).cast("binary"), 256).alias("base_sha256"),
                          spans_text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents (their own columns) with every span's characters replaced by ``mark``;
    overlapping spans become one.  A text without spans stays as it is, null included."""
    def cut(spans: Column, text: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(a: Column, x: Column) -> Column:
            fresh = x["start"] >= a["at"]
            gap = F.when(fresh, F.concat(F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))).otherwise(F.lit(""))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.concat(a["out"], gap).alias("out"))

        return F.aggregate(spans, first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))

    scanned = scan(docs, "_scan_spans")
    some = F.size("_scan_spans") > 0
    out = scanned.withColumn("_scan_text", F.when(some, cut(F.col("_scan_spans"), F.col("text").cast("string"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("_scan_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.withColumn("text", F.col("_scan_text")).select(*docs.columns)
