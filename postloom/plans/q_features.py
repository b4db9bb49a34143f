"""Queries: stylometry, perplexity, token ids, embeddings, clean track,
split sync, model hook (F1-F9, J11, N10, P9)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from postloom.functions import stylometry as ST
from postloom.operators import dense as DE
from postloom.operators import features as FE
from postloom.operators import language_model as LM
from postloom.operators import sampling as SA
from postloom.operators import sentences as SE
from postloom.operators import subwords as SW
from postloom.plans import sqlfrag as S
from postloom.plans.registry import query, spread, table
from postloom.plans.views import posts, with_posts
from postloom.session import discard, materialize, scratch_path

WORD_RE = FE.WORD_RE


@query("burstiness", "F1", f"SELECT doc_id, round({S.burstiness('text')}, 6) AS burstiness FROM documents")
def burstiness(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(ST.burstiness("text"), 6).alias("burstiness"))


@query("burstiness_learned", "F1", f"""WITH toks AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), {S.q(SE.TYPE_RE)}, 0)) AS t FROM documents),
 types AS (SELECT regexp_replace(t, '\\.$', '') AS type, CAST(count(*) FILTER (ends_with(t, '.')) AS DOUBLE) AS c1,
                  CAST(count(*) FILTER (NOT ends_with(t, '.')) AS DOUBLE) AS c0 FROM toks GROUP BY 1),
 tot AS (SELECT sum(c1) / sum(c1 + c0) AS p FROM types),
 sized AS (SELECT *, CAST(length(replace(type, '.', '')) AS DOUBLE) AS n, CAST(length(type) - length(replace(type, '.', '')) AS DOUBLE) AS inner_ FROM types, tot WHERE c1 > 0),
 ab AS (SELECT type FROM sized WHERE regexp_matches(type, '\\p{{L}}') AND 2 * ((c1 * ln({SE.ABBREVIATION_SHARE}) + c0 * ln(1 - {SE.ABBREVIATION_SHARE}))
          - (c1 * ln(p) + CASE WHEN p >= 1 THEN 0 ELSE c0 * ln(1 - p) END)) * exp(-n) * (inner_ + 1) * pow(n, -c0) >= {SE.THRESHOLD}
          OR regexp_matches(type, '^\\p{{L}}$')),
 parts AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS s FROM (SELECT doc_id, {S.sentences("text")} AS s FROM documents)),
 f AS (SELECT doc_id, i, CAST(len({S.tokens("s")}) AS DOUBLE) AS n, regexp_extract(lower(s), {S.q(SE.LAST_RE)}, 1) IN (SELECT type FROM ab) AS goes_on FROM parts),
 g AS (SELECT doc_id, n, coalesce(sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sid FROM f),
 l AS (SELECT doc_id, var_pop(n) AS v FROM (SELECT doc_id, sid, sum(n) AS n FROM g GROUP BY doc_id, sid) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(v, 0.0), 6) AS burstiness FROM documents d LEFT JOIN l USING (doc_id)""")
def burstiness_learned(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    return SE.learned_burstiness(docs, "doc_id").select("doc_id", F.round("burstiness", 6).alias("burstiness"))


@query("punctuation_density", "F2",
       f"SELECT doc_id, round({S.punct_density('text')}, 6) AS punctuation_density FROM documents")
def punctuation_density(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.round(ST.punctuation_density("text"), 6).alias("punctuation_density"))


@query("lexical_diversity", "F3",
       f"SELECT doc_id, round({S.lexical_diversity('text')}, 6) AS lexical_diversity FROM documents")
def lexical_diversity(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.round(ST.lexical_diversity("text"), 6).alias("lexical_diversity"))


def ppl_sql(where: str = "") -> str:
    return f""", toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {S.q(WORD_RE)}, 0) AS t FROM documents {where}),
 occ AS (SELECT doc_id, t[i] AS prev, t[i + 1] AS w FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks WHERE len(t) >= 2)),
 per_doc AS (SELECT doc_id, prev, w, count(*) AS k FROM occ GROUP BY ALL),
 bigram AS (SELECT prev, w, sum(k) AS c_bw FROM per_doc GROUP BY ALL),
 unigram AS (SELECT word AS prev, count(*) AS c_prev FROM (SELECT unnest(t) AS word FROM toks) GROUP BY word),
 scored AS (SELECT b.prev, b.w, -ln(CAST(b.c_bw + 1 AS DOUBLE) / CAST(u.c_prev + (SELECT count(*) FROM unigram) AS DOUBLE)) AS nll
            FROM bigram b JOIN unigram u USING (prev)),
 dn AS (SELECT doc_id, sum(nll * k) / sum(k) AS m FROM per_doc JOIN scored USING (prev, w) GROUP BY doc_id),
 ppl AS (SELECT toks.doc_id, coalesce(exp(m), 0.0) AS perplexity FROM toks LEFT JOIN dn USING (doc_id))
"""


PPL_SQL = ppl_sql()


@query("perplexity_bigram", "F4", f"WITH {PPL_SQL.lstrip(', ')} SELECT doc_id, round(perplexity, 6) AS perplexity FROM ppl")
def perplexity_bigram(spark, d):
    p = FE.bigram_perplexity(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")
    return p.select("doc_id", F.round("perplexity", 6).alias("perplexity"))


KN_SQL = f"""WITH toks AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), {S.q(WORD_RE)}, 0) AS t FROM documents),
 per_doc AS (SELECT doc_id, t[i] AS prev, t[i + 1] AS w, count(*) AS k FROM (SELECT doc_id, t, unnest(range(1, len(t))) AS i FROM toks WHERE len(t) >= 2) GROUP BY ALL),
 b AS (SELECT prev, w, sum(k) AS c FROM per_doc GROUP BY ALL),
 voc AS (SELECT count(DISTINCT word) AS v FROM (SELECT unnest(t) AS word FROM toks)),
 bw AS (SELECT w, count(*) AS n FROM b GROUP BY w),
 bp AS (SELECT prev, CAST(sum(c) AS DOUBLE) AS c_prev, count(*) AS n_after FROM b GROUP BY prev),
 d AS (SELECT CASE WHEN count(*) FILTER (c = 1) = 0 THEN {LM.PLAIN_DISCOUNT} ELSE count(*) FILTER (c = 1) / CAST(count(*) FILTER (c = 1) + 2 * count(*) FILTER (c = 2) AS DOUBLE) END AS d FROM b),
 d1 AS (SELECT CASE WHEN count(*) FILTER (n = 1) = 0 THEN {LM.PLAIN_DISCOUNT} ELSE count(*) FILTER (n = 1) / CAST(count(*) FILTER (n = 1) + 2 * count(*) FILTER (n = 2) AS DOUBLE) END AS d1,
               CAST(sum(n) AS DOUBLE) AS types, count(*) AS followers FROM bw),
 p1 AS (SELECT w, greatest(n - d1, 0) / types + d1 * followers / types / (v + 1) AS p1 FROM bw, d1, voc),
 s AS (SELECT b.prev, b.w, -ln(greatest(c - d, 0) / c_prev + d * n_after / c_prev * p1) AS nll FROM b JOIN bp USING (prev) JOIN p1 USING (w), d),
 m AS (SELECT doc_id, sum(nll * k) / sum(k) AS m FROM per_doc JOIN s USING (prev, w) GROUP BY doc_id)
SELECT doc_id, round(coalesce(exp(m), 0.0), 6) AS perplexity FROM toks LEFT JOIN m USING (doc_id)"""


@query("perplexity_kneser_ney", "F4", KN_SQL)
def perplexity_kneser_ney(spark, d):
    p = LM.kneser_ney_perplexity(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")
    return p.select("doc_id", F.round("perplexity", 6).alias("perplexity"))


SPLIT_SQL = """, sr AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42|' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rk,
                count(*) OVER () AS n FROM documents WHERE text IS NOT NULL),
 sp AS (SELECT doc_id, CASE WHEN rk < n - (3 * n + 9) // 10 THEN 'train'
                       WHEN rk < n - (3 * n + 9) // 10 + (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 THEN 'val'
                       ELSE 'test' END AS split_group FROM sr)
"""


# the raw track reads the clean table: texts whose cleaned form is empty are not in it
CLEANABLE = f"WHERE text IS NOT NULL AND length({S.clean('text')}) > 0"


@query("feature_table", "F5/J11", f"""WITH {ppl_sql(CLEANABLE).lstrip(', ')}{SPLIT_SQL}
SELECT d.doc_id, sp.split_group, 0 AS label, round(ppl.perplexity, 6) AS perplexity,
  round({S.burstiness('d.text')}, 6) AS burstiness, round({S.punct_density('d.text')}, 6) AS punctuation_density,
  round({S.lexical_diversity('d.text')}, 6) AS lexical_diversity
FROM documents d JOIN ppl USING (doc_id) JOIN sp USING (doc_id)""")
def feature_table(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    split = SA.split_exact(docs.filter(F.col("text").isNotNull()), ["doc_id"], "42")
    path = scratch_path(spark, "raw-track")
    clean = materialize(split.filter(F.length(FE.T.clean_text("text")) > 0), "raw-track", path)
    out = FE.stylometric_features(clean, "doc_id", carry=["split_group"])
    discard(spark, path)  # what is returned reads the blocks of the texts, stored by now
    return out.select("doc_id", "split_group", F.lit(0).alias("label"),
                      *[F.round(c, 6).alias(c) for c in ("perplexity", "burstiness", "punctuation_density",
                                                         "lexical_diversity")])


TOK_SQL = f""", c AS (SELECT doc_id, {S.clean('text')} AS ct FROM documents),
 tk AS (SELECT doc_id, list_filter(string_split(ct, ' '), lambda w: w <> '') AS t FROM c),
 cnt AS (SELECT DISTINCT unnest(t) AS word FROM tk),
 vocab AS (SELECT word, row_number() OVER (ORDER BY md5('vocab|' || word), word) + 3 AS id FROM cnt),
 e AS (SELECT doc_id, unnest(t) AS word, unnest(range(len(t))) AS pos FROM tk),
 l AS (SELECT e.doc_id, e.pos // 510 AS seq_no, list(v.id ORDER BY e.pos) AS body FROM e JOIN vocab v USING (word) GROUP BY ALL),
 ids AS (SELECT doc_id, seq_no, [2] || body || [3] AS input_ids FROM l
         UNION ALL SELECT doc_id, 0, [2, 3] FROM tk WHERE len(t) = 0)
"""


def _doc_ids(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", FE.T.clean_text("text").alias("ct"))
    return FE.token_ids(materialize(docs, "cleaned-texts"), "doc_id", "ct")


@query("token_ids", "F6", f"""WITH {TOK_SQL.lstrip(', ')}
SELECT doc_id, CAST(seq_no AS BIGINT) AS seq_no, CAST(len(input_ids) AS BIGINT) AS n_ids, array_to_string(input_ids, ' ') AS ids FROM ids""")
def token_ids(spark, d):
    ids = _doc_ids(spark, d)
    return ids.select("doc_id", F.col("seq_no").cast("long").alias("seq_no"), F.size("input_ids").cast("long").alias("n_ids"),
                      F.array_join(F.col("input_ids").cast("array<string>"), " ").alias("ids"))


@query("pad_batches", "F6 padding", f"""WITH {TOK_SQL.lstrip(', ')},
 r AS (SELECT doc_id, seq_no, len(input_ids) AS n,
         (row_number() OVER (ORDER BY md5('batch|' || CAST(doc_id AS VARCHAR) || '|' || CAST(seq_no AS VARCHAR)), doc_id, seq_no) - 1) // 32 AS batch_id FROM ids)
SELECT doc_id, CAST(seq_no AS BIGINT) AS seq_no, CAST(batch_id AS BIGINT) AS batch_id,
       CAST(max(n) OVER (PARTITION BY batch_id) AS BIGINT) AS padded_len, CAST(n AS BIGINT) AS mask_sum FROM r""")
def pad_batches(spark, d):
    p = FE.pad_batches(_doc_ids(spark, d), ["doc_id", "seq_no"])
    return p.select("doc_id", F.col("seq_no").cast("long").alias("seq_no"), "batch_id", F.size("input_ids").cast("long").alias("padded_len"),
                    F.aggregate("attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("mask_sum"))


# pieces are learned by iteration, which SQL cannot express; that ids are never unknown and stand for the words, it can
@query("subword_ids", "F6", f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS ct FROM documents)
SELECT doc_id, array_to_string(list_filter(string_split(ct, ' '), lambda w: w <> ''), ' ') AS decoded, CAST(0 AS BIGINT) AS n_unknown FROM c""")
def subword_ids(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", FE.T.clean_text("text").alias("ct"))
    docs = materialize(docs, "cleaned-texts")
    tokens = FE.clean_words("ct")
    pieces = SW.train(SW.count_words(docs, tokens))
    ids = docs.select("doc_id", SW.piece_ids(pieces, docs, tokens).alias("ids"))
    return ids.select("doc_id", SW.decoded(pieces, docs, F.col("ids")).alias("decoded"),
                      F.size(F.filter("ids", lambda i: i == FE.UNK)).cast("long").alias("n_unknown"))


DIM = 8


@query("hashed_embedding", "F7", f"""WITH c AS (SELECT doc_id, {S.clean('text')} AS ct FROM documents),
 tk AS (SELECT doc_id, list_filter(string_split(ct, ' '), lambda w: w <> '') AS t FROM c),
 b AS (SELECT doc_id, list_transform(t, lambda w: CAST(('0x' || substr(md5('emb|' || w), 1, 8)) AS BIGINT) % {DIM}) AS b FROM tk),
 cc AS (SELECT doc_id, list_transform(range({DIM}), lambda i: CAST(len(list_filter(b, lambda v: v = i)) AS DOUBLE)) AS c FROM b),
 nn AS (SELECT doc_id, c, sqrt(list_sum(list_transform(c, lambda v: v * v))) AS norm FROM cc)
SELECT doc_id, {', '.join(f'round(CASE WHEN norm = 0 THEN c[{i + 1}] ELSE c[{i + 1}] / norm END, 6) AS e{i}' for i in range(DIM))}
FROM nn""")
def hashed_embedding(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("ct", FE.T.clean_text("text"))
    e = FE.hashed_embedding(docs, "doc_id", "ct", dim=DIM)
    return e.select("doc_id", *[F.round(F.col("embedding")[i], 6).alias(f"e{i}") for i in range(DIM)])


@query("svd_embedding", "F7")  # singular vectors have no SQL form: tested against numpy
def svd_embedding(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("ct", FE.T.clean_text("text"))
    return DE.svd_embedding(docs, "doc_id", "ct")


@query("clean_track", "F8/N10/P9/T18", with_posts(f"""
, sr AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || platform || '|' || post_id), platform, post_id) - 1 AS rk,
                count(*) OVER () AS n FROM posts_v WHERE text IS NOT NULL),
 sp AS (SELECT *, CASE WHEN rk < n - (3 * n + 9) // 10 THEN 'train'
                       WHEN rk < n - (3 * n + 9) // 10 + (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 THEN 'val'
                       ELSE 'test' END AS split_group, {S.clean('text')} AS cleaned_text FROM sr),
 tk AS (SELECT *, list_filter(string_split(cleaned_text, ' '), lambda w: w <> '') AS t FROM sp WHERE length(cleaned_text) > 0),
 vocab AS (SELECT word, row_number() OVER (ORDER BY md5('vocab|' || word), word) + 3 AS id FROM (SELECT DISTINCT unnest(t) AS word FROM tk)),
 total AS (SELECT platform, post_id, sum(id) AS s FROM (SELECT platform, post_id, unnest(t) AS word FROM tk) JOIN vocab USING (word) GROUP BY ALL)
SELECT platform, post_id, split_group, 0 AS label, 'human_written' AS category, cleaned_text,
  CAST(len(t) + 2 * ((len(t) + 509) // 510) AS BIGINT) AS n_ids, CAST(s + 5 * ((len(t) + 509) // 510) AS BIGINT) AS sum_ids
FROM tk JOIN total USING (platform, post_id)"""))
def clean_track(spark, d):
    t = FE.clean_track(spread(posts(spark, d)), ["platform", "post_id"])
    flat = F.flatten("input_ids")
    return t.select("platform", "post_id", "split_group", "label", "category", "cleaned_text", F.size(flat).cast("long").alias("n_ids"),
                    F.aggregate(flat, F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


@query("split_sync", "J11", with_posts(f"""
, sr AS (SELECT *, row_number() OVER (ORDER BY md5('42|' || platform || '|' || post_id), platform, post_id) - 1 AS rk,
                count(*) OVER () AS n FROM posts_v WHERE text IS NOT NULL),
 sp AS (SELECT *, CASE WHEN rk < n - (3 * n + 9) // 10 THEN 'train'
                       WHEN rk < n - (3 * n + 9) // 10 + (3 * n + 9) // 10 - ((3 * n + 9) // 10 + 1) // 2 THEN 'val'
                       ELSE 'test' END AS split_group FROM sr WHERE length({S.clean('text')}) > 0)
SELECT platform, post_id, split_group, 0 AS label, round({S.punct_density('text')}, 6) AS punctuation_density,
       round({S.lexical_diversity('text')}, 6) AS lexical_diversity FROM sp"""))
def split_sync(spark, d):
    # split and label are columns of the clean table and travel with the row, so rows the clean track
    # drops (empty cleaned text) drop here too
    p = posts(spark, d).filter(F.col("text").isNotNull())
    split = SA.split_exact(p.select("platform", "post_id", "text"), ["platform", "post_id"], "42")
    clean = split.filter(F.length(FE.T.clean_text("text")) > 0)
    return clean.select("platform", "post_id", "split_group", F.lit(0).alias("label"), F.round(ST.punctuation_density("text"), 6).alias("punctuation_density"),
                        F.round(ST.lexical_diversity("text"), 6).alias("lexical_diversity"))


def _word_count_model():
    """Stand-in scorer (no weights ship here): Python whitespace word count."""
    def score(s: pd.Series) -> pd.Series:
        return s.fillna("").str.split().str.len().astype("float64")
    return score


@query("model_hook", "F9", f"""SELECT doc_id,
  CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), {S.q(FE.T.SPACE + '+')}), lambda x: x <> '')) AS DOUBLE) AS score
FROM documents""")
def model_hook(spark, d):
    return FE.model_hook(table(spark, d, "documents"), "text", _word_count_model).select("doc_id", "score")
