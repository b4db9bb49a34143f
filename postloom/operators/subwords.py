"""subword pieces learned from the corpus (a unigram language model), and their ids.

Training: words are counted in Spark.  Seeds are the substrings of words (with a mark for the word's
start) by count times length, and all characters.  Then expectation-maximisation: a word's possible
segmentations are weighed by the product of their pieces' probabilities (forward and backward sums
over the word's positions), each task adds up the expected counts of its words, Spark adds them per
piece, and the driver normalises; the least used pieces go until ``size`` are left (characters stay).
Both work on many words at a time: their characters lie one after another, a trie in sorted arrays
finds the pieces that begin at each, and sums and maxima run over the characters' places in their words.
What passes through the driver and a broadcast is the piece table: at most ``seeds`` pieces and the
characters of the corpus, whatever its length.

Encoding is one pass over the rows, without shuffle: each word takes its most probable
segmentation, distinct words of an Arrow batch once.  A character that the corpus never held becomes the bytes of its UTF-8 form, which have ids of
their own, so no word is unknown and ids decode to the words exactly.

Ids: 0 pad, 1 unknown (never given), 2 start, 3 end, 4-259 bytes, then pieces by probability."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from postloom import config
from postloom.operators import features as FE
from postloom.session import materialize

START = "▁"
LONGEST = 8  # characters of a piece, the mark not counted
SIZE, SEEDS = 8000, 40000
SHORT = 4  # characters of the substrings that are all counted
ROUNDS = 1  # expectation-maximisation rounds before each cut and after the last
KEEP = 0.5  # share of the pieces that a cut leaves
FIRST_BYTE, FIRST_PIECE = 4, 260
_NONE = -math.inf
CHARS = 1 << 17  # characters that are worked on at a time (a longer word alone)


def count_words(df: DataFrame, tokens: Column) -> DataFrame:
    """(word, n) with the start mark, over all rows."""
    return df.select(F.explode(tokens).alias("w")).groupBy("w").agg(F.count("*").alias("n")).select(F.concat(F.lit(START), F.col("w")).alias("word"), "n")


def seed_pieces(words: DataFrame, seeds: int = SEEDS) -> dict[str, float]:
    """Counts of the seeds: the ``seeds`` substrings of two characters or more with the largest count times
    length (ties by text) that occur twice at least, and every character.

    Substrings of up to ``SHORT`` characters are counted first.  The last of the seeds among them bounds what a longer
    one needs: its count times the greatest length must reach that, and so must the count of its beginning.  So of the many
    longer substrings only those after a frequent beginning are counted; none that is a seed is missed."""
    left = F.length("word") - F.col("at") + 1
    places = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))

    def counted(at: DataFrame, least: int, most: int) -> DataFrame:
        cut = at.where(left >= least).select("word", "n", "at", F.explode(F.sequence(F.lit(least), F.least(F.lit(most), left))).alias("size"))
        return cut.groupBy(F.substring("word", F.col("at"), F.col("size")).alias("piece"), "size").agg(F.sum("n").alias("n"))

    def best(pieces: DataFrame) -> list:
        return pieces.where("size > 1 and n > 1").orderBy(F.desc(F.col("n") * F.col("size")), "piece").limit(seeds).select("piece", "n", "size").collect()

    short = materialize(counted(places, 1, SHORT), "piece-seeds")
    chars, first = short.where("size = 1").select("piece", "n").collect(), best(short)
    bound = first[-1].n * first[-1].size if len(first) == seeds else 0
    begins = short.where((F.col("size") == SHORT) & (F.col("n") > 1) & (F.col("n") * (LONGEST + 1) >= bound)).select(F.col("piece").alias("begin"))
    places = places.where(left > SHORT).withColumn("begin", F.substring("word", F.col("at"), F.lit(SHORT))).join(begins, "begin", "left_semi")
    long_ = best(counted(places, SHORT + 1, LONGEST + 1).unionByName(short))
    return {r.piece: float(r.n) for r in [*chars, *long_]}


class Trie:
    """Pieces by their characters: a node's child under a character is found in one sorted array."""

    def __init__(self, logs: dict[str, float]):
        self.pieces, self.logs = list(logs), np.array(list(logs.values()), np.float64)
        self.alphabet = np.unique(np.array([ord(c) for p in logs for c in p], np.int64))
        place, children, piece = {chr(c): k for k, c in enumerate(self.alphabet.tolist())}, {}, [-1]
        for k, p in enumerate(self.pieces):
            node = 0
            for c in p:
                node = children.setdefault(node * len(place) + place[c], len(piece))
                if node == len(piece):
                    piece.append(-1)
            piece[node] = k
        self.edges = np.array(sorted(children), np.int64)
        self.child = np.array([children[e] for e in self.edges.tolist()], np.int64)
        self.piece = np.array(piece, np.int64)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Children of nodes, -1 where there is none (``char``: places in the alphabet)."""
        key = node * len(self.alphabet) + char
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where(self.edges[at] == key, self.child[at], -1)


class Lattice:
    """The pieces in some words, as arcs between places: word ``w`` has a place before each of its characters and one
    at its end, ``first[w]`` .. ``last[w]``.  Arcs are ordered by the offset of their begin in the word, begin and length."""

    def __init__(self, words: list[str], trie: Trie, unknown: float | None = None):
        sizes = np.array([len(w) for w in words], np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        self.last = np.cumsum(sizes + 1) - 1
        self.first = self.last - sizes
        word = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(codes)) + word  # of each character: the ends of the words before it count
        left = self.last[word] - place  # characters from here to the word's end
        none = np.zeros(0, np.int64)
        begin, length, piece = [none], [none], [none]
        if len(trie.alphabet):
            char = np.minimum(np.searchsorted(trie.alphabet, codes), len(trie.alphabet) - 1)
            known = trie.alphabet[char] == codes
            at, node = np.flatnonzero(known), np.zeros(int(known.sum()), np.int64)
            for k in range(1, LONGEST + 2):
                node = trie.step(node, char[at + k - 1])
                at, node = at[node >= 0], node[node >= 0]
                found = trie.piece[node] >= 0
                begin, length, piece = [*begin, at[found]], [*length, np.full(int(found.sum()), k)], [*piece, trie.piece[node[found]]]
                on = left[at] > k
                at, node = at[on], node[on]
                on = known[at + k]
                at, node = at[on], node[on]
        if unknown is not None:  # a character that is no piece
            is_piece = np.zeros(len(codes), bool)
            is_piece[np.concatenate([b[x == 1] for b, x in zip(begin, length, strict=True)])] = True
            rest = np.flatnonzero(~is_piece)
            begin, length, piece = [*begin, rest], [*length, np.ones(len(rest), np.int64)], [*piece, np.full(len(rest), -1)]
        at, length, piece = np.concatenate(begin), np.concatenate(length), np.concatenate(piece)
        offset = place[at] - self.first[word[at]]
        order = np.argsort((offset * (len(codes) + 1) + at) * (LONGEST + 2) + length)
        self.word, self.begin, self.piece = word[at][order], place[at][order], piece[order]
        self.end = self.begin + length[order]
        self.log = np.where(self.piece >= 0, np.append(trie.logs, 0.0)[self.piece], 0.0 if unknown is None else unknown)
        self.cuts = np.searchsorted(offset[order], np.arange(int(sizes.max(initial=0)) + 1))  # arcs that begin at each offset
        self.places = int(self.last[-1]) + 1 if len(words) else 0

    def steps(self) -> list[slice]:
        return [slice(a, b) for a, b in zip(self.cuts[:-1].tolist(), self.cuts[1:].tolist(), strict=True) if b > a]


def _blocks(words: list[str]) -> Iterator[slice]:
    """Consecutive words of about ``CHARS`` characters."""
    begin, chars = 0, 0
    for k, w in enumerate(words):
        if chars and chars + len(w) > CHARS:
            yield slice(begin, k)
            begin, chars = k, 0
        chars += len(w)
    if words:
        yield slice(begin, len(words))


def expectation(words: list[str], n: np.ndarray, trie: Trie) -> np.ndarray:
    """How often each piece is expected in the words, ``n`` times each, over all their segmentations."""
    total = np.zeros(len(trie.pieces))
    for block in _blocks(words):
        lattice = Lattice(words[block], trie)
        begin, end, log, ahead, behind = lattice.begin, lattice.end, lattice.log, *np.full((2, lattice.places), _NONE)
        ahead[lattice.first], behind[lattice.last] = 0.0, 0.0
        for s in lattice.steps():  # of one offset no two arcs end at one place
            ahead[end[s]] = np.logaddexp(ahead[end[s]], ahead[begin[s]] + log[s])
        for s in reversed(lattice.steps()):
            here = np.flatnonzero(np.diff(begin[s], prepend=-1))
            behind[begin[s][here]] = np.logaddexp.reduceat(log[s] + behind[end[s]], here)
        whole = ahead[lattice.last][lattice.word]
        some = np.flatnonzero(whole > _NONE)
        x = ahead[begin[some]] + log[some] + behind[end[some]] - whole[some]
        some, x = some[x > -50], x[x > -50]
        total += np.bincount(lattice.piece[some], weights=np.exp(x) * n[block][lattice.word[some]], minlength=len(total))
    return total


def expected_counts(word: str, logs: dict[str, float]) -> dict[str, float]:
    """How often each piece is expected in the word, over all its segmentations."""
    total = expectation([word], np.ones(1), Trie(logs))
    return {p: x for p, x in zip(logs, total.tolist(), strict=True) if x}


def segmented(words: list[str], trie: Trie, worst: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The most probable segmentations, by blocks: (word, end in the word, piece) of each part in order, piece -1 for a
    character that is none, which costs ``worst`` less ten.  Of equals the one whose last pieces are longest."""
    for block in _blocks(words):
        lattice = Lattice(words[block], trie, worst - 10)
        score, back = np.full(lattice.places, _NONE), np.zeros(lattice.places, np.int64)
        score[lattice.first] = 0.0
        for s in lattice.steps():  # longer pieces first: their begin is smaller
            x, end = score[lattice.begin[s]] + lattice.log[s], lattice.end[s]
            better = np.flatnonzero(x > score[end])
            score[end[better]], back[end[better]] = x[better], s.start + better
        used, open_ = np.zeros(lattice.places, bool), np.ones(lattice.places, bool)
        open_[lattice.first] = False
        here = lattice.last[open_[lattice.last]]
        while len(here):  # from the ends back, all words at once
            used[here] = True
            here = lattice.begin[back[here]]
            here = here[open_[here]]
        ends = np.flatnonzero(used)
        arcs = back[ends]
        word = lattice.word[arcs]
        yield block.start + word, ends - lattice.first[word], lattice.piece[arcs]


def best_pieces(word: str, logs: dict[str, float], worst: float) -> list[str]:
    """The most probable segmentation of one word (see ``segmented``)."""
    ends = [e for _, at, _ in segmented([word], Trie(logs), worst) for e in at.tolist()]
    return [word[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def _expect(trie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(trie.value.pieces))
        for b in batches:
            total += expectation(b["word"].to_pylist(), b["n"].to_numpy(), trie.value)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": pa.array(some, pa.int64()), "x": pa.array(total[some])})

    return run


def normalised(counts: dict[str, float]) -> dict[str, float]:
    total = sum(counts[p] for p in sorted(counts))
    return {p: math.log(n / total) for p, n in counts.items()}


def cut(counts: dict[str, float], size: int) -> dict[str, float]:
    """The most used pieces: ``KEEP`` of them, but ``size`` at least; characters stay."""
    left = max(size, int(len(counts) * KEEP))
    ranked = sorted(counts, key=lambda p: (len(p) > 1, -float(f"{counts[p]:.9g}"), p))
    return {p: counts[p] for p in ranked[: max(left, sum(len(p) == 1 for p in counts))]}


def used(counts: dict[str, float], before: dict[str, float]) -> dict[str, float]:
    """Expected counts with every character kept, and pieces that are hardly expected left out."""
    return {p: max(counts.get(p, 0.0), 1e-3 if len(p) == 1 else 0.0) for p in before if len(p) == 1 or counts.get(p, 0.0) > 1e-6}


def train(words: DataFrame, size: int = SIZE, seeds: int = SEEDS) -> Pieces:
    """Pieces for the counted words (word with its mark, n)."""
    spark = words.sparkSession
    # the work is by word, not by byte: as many partitions as any shuffle has, however small the table
    words = materialize(words.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "subword-words")
    counts = seed_pieces(words, seeds)

    def expect(counts: dict[str, float]) -> dict[str, float]:
        trie = Trie(normalised(counts))
        sent = spark.sparkContext.broadcast(trie)
        rows = words.mapInArrow(_expect(sent), "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()
        sent.unpersist()
        return used({trie.pieces[r.piece]: r.x for r in rows}, counts)

    return Pieces.of(learn(counts, size, expect))


def learn(counts: dict[str, float], size: int, expect) -> dict[str, float]:
    """Rounds of ``expect`` and cuts; log probabilities."""
    if not counts:
        return {}
    while True:
        for _ in range(ROUNDS):
            counts = expect(counts)
        if len(counts) <= max(size, sum(len(p) == 1 for p in counts)):
            return normalised(counts)
        counts = cut(counts, size)


@dataclass
class Pieces:
    logs: dict[str, float]
    ids: dict[str, int]
    worst: float

    @classmethod
    def of(cls, logs: dict[str, float]) -> Pieces:
        ranked = sorted(logs, key=lambda p: (-float(f"{logs[p]:.9g}"), p))
        return cls(logs, {p: FIRST_PIECE + k for k, p in enumerate(ranked)}, min(logs.values(), default=0.0))

    def table(self, spark) -> DataFrame:
        rows = [(p, i, self.logs[p]) for p, i in self.ids.items()]
        return spark.createDataFrame(rows, "piece string, id int, log_p double")

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("logs", "ids", "worst")}  # what follows from these is made where it is used

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words, one after another, and how many each has."""
        if not hasattr(self, "_trie"):
            self._trie, self._ids = Trie(self.logs), np.array([self.ids[p] for p in self.logs], np.int32)
        marked, ids, sizes = [START + w for w in words], [np.zeros(0, np.int32)], np.zeros(len(words), np.int64)
        for word, end, piece in segmented(marked, self._trie, self.worst):
            x, width, odd = np.append(self._ids, 0)[piece], np.ones(len(piece), np.int64), np.flatnonzero(piece < 0)
            if len(odd):  # characters that are no piece: their bytes
                raw = [marked[w][e - 1].encode("utf-8", "surrogatepass") for w, e in zip(word[odd].tolist(), end[odd].tolist(), strict=True)]
                width[odd] = [len(r) for r in raw]
                x = np.repeat(x, width)
                x[np.repeat(piece < 0, width)] = FIRST_BYTE + np.frombuffer(b"".join(raw), np.uint8).astype(np.int32)
            ids.append(x.astype(np.int32))
            sizes += np.bincount(word, weights=width, minlength=len(words)).astype(np.int64)
        return np.concatenate(ids), sizes

    def encode(self, words: list[str]) -> list[int]:
        """Ids of the words of one text."""
        return self.encode_words(words)[0].tolist()

    def encode_lists(self, texts: pa.Array) -> pa.Array:
        """Ids of the words of each text; none for null."""
        counts = texts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        words = texts.flatten().dictionary_encode()
        ids, sizes = self.encode_words(words.dictionary.to_pylist())
        code = words.indices.to_numpy()
        begin, size = (np.cumsum(sizes) - sizes)[code], sizes[code]
        total = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin - total[:-1], size) + np.arange(int(total[-1]))
        ends = total[np.concatenate([[0], np.cumsum(counts)])]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids[at], pa.int32()))

    def decode_lists(self, rows: pa.Array) -> pa.Array:
        """``decode`` of each row."""
        if not hasattr(self, "_letters"):
            known = {i: p.encode() for p, i in self.ids.items()} | {FIRST_BYTE + b: bytes([b]) for b in range(256)}
            self._letters = pa.array([known.get(i, b"") for i in range(max(known) + 2)], pa.large_binary())
        ids = rows.flatten().to_numpy()
        parts = self._letters.take(pa.array(np.where((ids < 0) | (ids >= len(self._letters)), 0, ids)))
        _, offsets, letters = parts.buffers()
        row_ends = np.concatenate([[0], np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
        ends = np.frombuffer(offsets, np.int64)[parts.offset : parts.offset + len(parts) + 1][row_ends] if len(parts) else row_ends
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(np.ascontiguousarray(ends)), letters or pa.py_buffer(b"")])
        try:
            texts = whole.cast(pa.large_string())
        except pa.ArrowInvalid:  # ids that cut a character
            texts = pa.array([x.decode("utf-8", "replace") for x in whole.to_pylist()], pa.large_string())
        return pc.utf8_slice_codeunits(pc.replace_substring(texts, START, " "), 1).cast(pa.string())

    def decode(self, ids: list[int]) -> str:
        """The words of ids, joined by a space; other marks are skipped."""
        if not hasattr(self, "_bytes"):
            self._bytes = {i: p.encode() for p, i in self.ids.items()} | {FIRST_BYTE + b: bytes([b]) for b in range(256)}
        raw = b"".join([self._bytes.get(i, b"") for i in ids])
        return raw.decode("utf-8", "replace").replace(START, " ")[1:]


def piece_ids(pieces: Pieces, df: DataFrame, words: Column) -> Column:
    """array<int>: the ids of a row's words."""
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    @arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield sent.value.encode_lists(b)

    return encode.asNondeterministic()(words)  # not worked out again for each column that uses the ids


def decoded(pieces: Pieces, df: DataFrame, ids: Column) -> Column:
    sent = df.sparkSession.sparkContext.broadcast(pieces)

    @arrow_udf("string")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield sent.value.decode_lists(b)

    return decode(ids)


def subword_sequences(df: DataFrame, key: str | list[str], cleaned: str, pieces: Pieces | None = None, size: int = SIZE,
                      max_len: int = config.MAX_SEQUENCE_TOKENS) -> DataFrame:
    """(key, seq_no, input_ids): ``[start] ids... [end]`` of at most ``max_len`` ids, consecutive ones for a
    longer text.  Pieces are learned from the texts themselves by default (give a stored table then, it is read twice)."""
    tokens = FE.clean_words(cleaned)
    if pieces is None:
        pieces = train(count_words(df, tokens), size)
    rows = df.select(*FE._keys(key), piece_ids(pieces, df, tokens).alias("__ids"))
    return rows.select(*FE._keys(key), F.posexplode(FE.cut_sequences(F.col("__ids"), max_len)).alias("seq_no", "input_ids"))
