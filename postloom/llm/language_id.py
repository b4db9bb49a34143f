"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

Method: a word is a maximal run of letters and marks of one script, lower-cased.  Its features are
its letter trigrams (with its edges) and itself, hashed into ``BUCKETS`` buckets each; a language's
score is the sum of the logarithms of their shares among the features of its texts, add-``ALPHA``
smoothed.  Only languages that write at least ``SCRIPT_SHARE`` of their letters in the word's
script are candidates (all languages, if none does); the others get ``FLOOR``.  Scores are turned
into log probabilities among the candidates.  Viterbi then finds the best path of labels over the
words of a text, where each change of language costs ``PENALTY``; runs of words with one label are
the spans.  The text's language is the one that labels most letters, its score the mean
probability, letter by letter, that its words give to this language (0 where another one labels them).

Training: one Arrow map over all texts of a known language counts features per task, Spark adds
the counts per (lang, bucket), and a language's counts are packed into one row of 2 * ``BUCKETS``
numbers at most: what reaches the driver and goes out in a broadcast is (languages x 2 *
``BUCKETS``) numbers, whatever the corpus.  ``train`` counts every row it is given, ``training_rows``
leaves out those with crc32(doc_id as text) mod 4 = 2.  Labelling is one Arrow map, no shuffle.
The steps of Viterbi run over all texts of a chunk at once; memory is (words of a chunk x
languages), and chunks hold fewer texts if there are many languages.

Edge cases: a null text or one without a letter is ``und`` with score 0; so is every text if no
language could be learned.  Ties go to the language whose training texts hold more letters, then
to the name that sorts first.  A null doc_id counts as held out and is never learned from.  Rows
are kept one to one; extra columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import chunks, expand, mix, powers, squeeze, texts_of
from postloom.session import materialize

BUCKETS = 1 << 16
ALPHA = 0.3
SCRIPT_SHARE = 0.005
FLOOR = -40.0
PENALTY = 9.0
CHUNK_BYTES = 8 << 20  # of text, for eight languages or fewer
UNKNOWN = "und"
_GOLD, _BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93 | 1

# Blocks of Unicode by script (first and last code point).
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x870, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "syriac": [(0x700, 0x74F), (0x860, 0x86F)],
    "thaana": [(0x780, 0x7BF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "oriya": [(0xB00, 0xB7F)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "sinhala": [(0xD80, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "tibetan": [(0xF00, 0xFFF)],
    "myanmar": [(0x1000, 0x109F), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "ethiopic": [(0x1200, 0x139F), (0x2D80, 0x2DDF), (0xAB00, 0xAB2F)],
    "khmer": [(0x1780, 0x17FF)],
    "mongolian": [(0x1800, 0x18AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPT_NAMES = ["", *SCRIPTS]  # 0: no script of its own
_LAST = 0x33480  # no letter or mark lies between here and U+E0100


@dataclass
class _Tables:
    letter: np.ndarray
    inside: np.ndarray  # letters and marks
    script: np.ndarray
    lower: np.ndarray


_tables: list[_Tables] = []


def tables() -> _Tables:
    """What each code point is; made once per process."""
    if not _tables:
        kinds = [unicodedata.category(chr(c))[0] for c in range(_LAST)] + ["X"]
        letter = np.array([k == "L" for k in kinds])
        inside = letter | np.array([k == "M" for k in kinds])
        script, lower = np.zeros(_LAST + 1, np.uint8), np.arange(_LAST + 1, dtype=np.uint32)
        for k, name in enumerate(SCRIPT_NAMES):
            for a, b in SCRIPTS.get(name, ()):
                script[a : b + 1] = k
        for c in np.flatnonzero(letter):
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
        _tables.append(_Tables(letter, inside, script, lower))
    return _tables[0]


@dataclass
class Spelled:
    """Words of a chunk of texts as code points: word w has cps[at[start[w]] ...] - see ``words_of``."""

    cps: np.ndarray  # lower-cased code points of all words, one after the other
    first: np.ndarray  # word w: cps[first[w]:first[w + 1]]
    doc: np.ndarray  # text of each word
    begin: np.ndarray  # place of the word in its text, in code points
    letters: np.ndarray  # letters in it
    script: np.ndarray

    def hashes(self) -> np.ndarray:
        n = len(self.cps)
        up, down = powers(_BASE, n + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((self.cps.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
        return mix((sums[self.first[1:]] - sums[self.first[:-1]]) * down[self.first[:-1]])

    def features(self, some: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features of the words ``some``, one after the other, and where each word's begin (and the end)."""
        size = np.diff(self.first)[some]
        at = np.cumsum(size + 1) - (size + 1)  # its trigrams and itself
        place = np.repeat(self.first[:-1][some] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        c = self.cps[place].astype(np.uint64)
        left, right = np.r_[np.zeros(1, np.uint64), c[:-1]][: len(c)], np.r_[c[1:], np.zeros(1, np.uint64)][: len(c)]
        heads = np.cumsum(size) - size
        left[heads] = 0
        right[heads + size - 1] = 0
        tri = mix(left * np.uint64(_GOLD) ^ c * np.uint64(_BASE) ^ (right + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48)
        out = np.empty(len(c) + len(some), np.int64)
        own = at + size
        rest = np.ones(len(out), bool)
        rest[own] = False
        out[rest] = tri.astype(np.int64) % BUCKETS
        out[own] = BUCKETS + (hashes[some] >> np.uint64(48)).astype(np.int64) % BUCKETS
        return out, np.r_[at, len(out)]


def words_of(data: np.ndarray, at: np.ndarray) -> Spelled:
    """The words of texts given as UTF-8 bytes and offsets."""
    t = tables()
    raw = data.tobytes()
    cps = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    text_at = heads[at]  # in code points
    known = np.minimum(cps, _LAST)
    place = np.flatnonzero(t.inside[known])
    doc = np.searchsorted(text_at, place, "right") - 1
    known = known[place]
    script = t.script[known]
    new = np.ones(len(place), bool)
    if len(place):
        other = (script[1:] != script[:-1]) & (script[1:] > 0) & (script[:-1] > 0)
        new[1:] = (place[1:] != place[:-1] + 1) | (doc[1:] != doc[:-1]) | other
    first = np.r_[np.flatnonzero(new), len(place)].astype(np.int64)
    letter = np.concatenate([[0], np.cumsum(t.letter[known])])
    letters = letter[first[1:]] - letter[first[:-1]]
    begin = place[first[:-1]] - text_at[doc[first[:-1]]] if len(place) else np.zeros(0, np.int64)
    which = np.maximum.reduceat(script, first[:-1]) if len(place) else script
    words = Spelled(t.lower[known], first, doc[first[:-1]] if len(place) else doc, begin, letters, which)
    if (letters == 0).any():  # marks alone are no word
        keep = np.flatnonzero(letters > 0)
        size = np.diff(first)
        mask = np.repeat(letters > 0, size)
        words = Spelled(words.cps[mask], np.r_[0, np.cumsum(size[keep])].astype(np.int64), words.doc[keep], begin[keep], letters[keep], which[keep])
    return words


# -- training ---------------------------------------------------------------------------------

_COUNTS = "lang string, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        data, at = texts_of(batch["text"])
        lang = batch["lang"].dictionary_encode()
        code, names = lang.indices.to_numpy(), lang.dictionary.to_pylist()
        for i, j in chunks(at, CHUNK_BYTES):
            words = words_of(data[at[i] : at[j]], at[i : j + 1] - at[i])
            if not len(words.doc):
                continue
            h, of = words.hashes(), code[i:j][words.doc]
            _, some, times = np.unique(mix(h + of.astype(np.uint64) * np.uint64(_GOLD)), return_index=True, return_counts=True)
            feature, begin = words.features(some, h)
            weight, language = np.repeat(times, np.diff(begin)), np.repeat(of[some], np.diff(begin))
            sums = np.bincount(language * 2 * BUCKETS + feature, weight, len(names) * 2 * BUCKETS).reshape(len(names), -1)
            scripts = np.bincount(of * len(SCRIPT_NAMES) + words.script, words.letters, len(names) * len(SCRIPT_NAMES)).reshape(len(names), -1)
            for k, name in enumerate(names):
                both = np.r_[sums[k], scripts[k]].astype(np.int64)
                total[name] = total[name] + both if name in total else both
    for name, n in total.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(some), pa.string()), "bucket": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64())})


def _pack(table: pa.Table) -> pa.Table:
    n = np.zeros(2 * BUCKETS + len(SCRIPT_NAMES), np.int64)
    n[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return pa.table({"lang": table["lang"][:1], "counts": pa.array([squeeze(n)], pa.binary())})


@dataclass
class Model:
    """Languages, log shares of features (feature x language), and which scripts each language writes."""

    languages: list[str]
    logs: np.ndarray
    prior: np.ndarray
    writes: np.ndarray  # language x script

    def word_scores(self, words: Spelled) -> tuple[np.ndarray, np.ndarray]:
        """Log probabilities (distinct words x languages), and the distinct word of each word."""
        h = words.hashes()
        _, some, which = np.unique(mix(h + words.script.astype(np.uint64)), return_index=True, return_inverse=True)
        out = np.empty((len(some), len(self.languages)))
        for i in range(0, len(some), 1 << 15):  # so that the features of a block stay small
            part = some[i : i + (1 << 15)]
            feature, begin = words.features(part, h)
            score = np.add.reduceat(self.logs[feature], begin[:-1], axis=0).astype(np.float64)
            fits = self.writes[:, words.script[part]].T
            fits = fits | ~fits.any(1)[:, None]
            score = np.where(fits, score, -np.inf)
            top = score.max(1, keepdims=True)
            score -= top + np.log(np.exp(score - top).sum(1, keepdims=True))
            out[i : i + len(part)] = np.maximum(score, FLOOR)
        return out, which


def learn(rows: list[tuple[str, bytes]]) -> Model:
    rows = sorted((name, expand(bytes(raw), np.int64)) for name, raw in rows)
    counts = np.stack([n for _, n in rows]).astype(np.float64) if rows else np.zeros((0, 2 * BUCKETS + len(SCRIPT_NAMES)))
    letters = counts[:, 2 * BUCKETS :].sum(1)
    names, counts = [n for n, _ in rows], counts[letters > 0]
    names, letters = [n for n, x in zip(names, letters, strict=True) if x > 0], letters[letters > 0]
    # the more letters a language has, the earlier it comes: ties go to the earlier one
    order = np.lexsort((np.arange(len(names)), -letters)) if names else np.zeros(0, np.int64)
    counts, letters = counts[order], letters[order]
    logs = []
    for part in (counts[:, :BUCKETS], counts[:, BUCKETS : 2 * BUCKETS]):
        logs.append(np.log((part + ALPHA) / (part.sum(1, keepdims=True) + ALPHA * BUCKETS)))
    writes = counts[:, 2 * BUCKETS :] >= SCRIPT_SHARE * letters[:, None]
    prior = np.log(letters / letters.sum()) if names else letters
    return Model([names[k] for k in order], np.concatenate(logs, axis=1).T.astype(np.float32).copy(), prior, writes)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def train(rows: DataFrame) -> Model:
    """Counts every given row with a language and a text."""
    known = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = known.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).mapInArrow(_count, _COUNTS)
    added = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = materialize(added.groupBy("lang").applyInArrow(_pack, "lang string, counts binary"), "language-counts")
    return learn([(r.lang, r.counts) for r in packed.collect()])


# -- labelling --------------------------------------------------------------------------------


def viterbi(scores: np.ndarray, which: np.ndarray, doc: np.ndarray, n_docs: int, prior: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of every word; ``doc`` ascends, a word's scores are ``scores[which]``.

    One step handles the k-th word of all texts that have one: texts are taken by length, words
    step by step."""
    size = np.bincount(doc, minlength=n_docs)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(n_docs, np.int64)
    rank[order] = np.arange(n_docs)
    longest = int(size.max(initial=0))
    live = n_docs - np.searchsorted(np.sort(size), np.arange(longest), "right")  # texts with more than k words
    off = np.concatenate([[0], np.cumsum(live)])
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    place = off[nth] + rank[doc]
    word = np.empty(len(doc), np.int64)
    word[place] = which
    n_labels = scores.shape[1]
    value = np.tile(prior, (n_docs, 1)).astype(np.float64)
    best = np.zeros(len(doc), np.int16)  # the label from which a change comes
    stay = np.ones((len(doc), n_labels), bool)
    for k in range(longest):
        a, b, m = off[k], off[k + 1], live[k]
        v = value[:m]
        if k:
            top = v.argmax(1)
            best[a:b] = top
            change = v[np.arange(m), top] - penalty
            stay[a:b] = v >= change[:, None]
            np.maximum(v, change[:, None], out=v)
        v += scores[word[a:b]]
    label = np.empty(len(doc), np.int16)
    now = value.argmax(1).astype(np.int16)
    for k in range(longest - 1, -1, -1):
        a, b, m = off[k], off[k + 1], live[k]
        n = now[:m]
        label[a:b] = n
        now[:m] = np.where(stay[np.arange(a, b), n], n, best[a:b])
    return label[place]


def _labelled(model, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        limit = CHUNK_BYTES * 8 // max(8, len(m.languages))
        for batch in batches:
            data, at = texts_of(batch["text"])
            for i, j in chunks(at, limit):
                yield _one_chunk(m, batch["doc_id"][i:j], data[at[i] : at[j]], at[i : j + 1] - at[i], spans)

    return run


def _one_chunk(m: Model, ids: pa.Array, data: np.ndarray, at: np.ndarray, spans: bool) -> pa.RecordBatch:
    n, k = len(ids), max(1, len(m.languages))
    words = words_of(data, at)
    if m.languages and len(words.doc):
        scores, which = m.word_scores(words)
        label = viterbi(scores, which, words.doc, n, m.prior).astype(np.int64)
        votes = np.bincount(words.doc * k + label, words.letters, n * k).reshape(n, k)
        sure = np.bincount(words.doc * k + label, words.letters * np.exp(scores[which, label]), n * k).reshape(n, k)
        top = votes.argmax(1)
        total = votes.sum(1)
        score = sure[np.arange(n), top] / np.maximum(total, 1)
    else:
        words, label = Spelled(*[np.zeros(0, np.int64)] * 6), np.zeros(0, np.int64)
        total, top, score = np.zeros(n), np.zeros(n, np.int64), np.zeros(n)
    # runs of one label in one text
    new = np.flatnonzero(np.r_[True, (label[1:] != label[:-1]) | (words.doc[1:] != words.doc[:-1])]) if len(label) else np.zeros(0, np.int64)
    first = np.searchsorted(words.doc[new], np.arange(n + 1)).astype(np.int32)
    out = {"doc_id": ids, "lang_pred": pa.array([m.languages[t] if s > 0 else UNKNOWN for t, s in zip(top, total, strict=True)], pa.string()),
           "score": pa.array(np.clip(score, 0, 1), pa.float64()), "n_spans": pa.array(np.diff(first), pa.int64())}
    if spans:
        size = np.diff(words.first)
        last = np.r_[new[1:], len(label)][: len(new)] - 1
        one = pa.StructArray.from_arrays([pa.array(words.begin[new].astype(np.int32)), pa.array((words.begin[last] + size[last]).astype(np.int32)),
                                          pa.array([m.languages[x] for x in label[new]], pa.string())], ["start", "end", "lang"])
        out["spans"] = pa.ListArray.from_arrays(pa.array(first), one)
    return pa.RecordBatch.from_pydict(out)


def label_spans(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score, n_spans and, if asked for, spans (start, end, lang; code points, end exclusive)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, lang_pred string, score double, n_spans long"
    schema += ", spans array<struct<start: int, end: int, lang: string>>" if spans else ""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_labelled(sent, spans), schema)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_spans for every row."""
    model = model or train(training_rows(docs))
    return label_spans(docs, model, spans=False).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_spans")
