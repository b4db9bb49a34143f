"""BPE encoding and decoding with the vocabulary of a public tokenizer file.

Method: batched numpy merge rounds.  The texts of a run are cut at ASCII white space (no word of
the file's pattern crosses it, and neither does composing) and dictionary-encoded, so that what
follows is done once per distinct string of a run: the pattern cuts it into words, and all words
that are not known yet lie in one flat symbol array.  In each round every neighbouring pair is
looked up by binary search over the sorted pair keys of the merge table, every word merges its
pair of lowest rank (all its places, left to right), and words without a pair leave the array.
A text's ids, and their decimal and token forms, are gathered from those of its strings.

Map only: no shuffle, and a task holds one run of texts, the merge table (shipped once to
each executor; its size is that of the tokenizer file) and a bounded table of known words in two
generations: when the younger is full, the older one goes, so words in use stay known
(as do the strings that they make).

The result equals the tokenizers library's ``encode(text, add_special_tokens=False)`` and
``decode(ids, skip_special_tokens=False)``: special tokens found in a text get their ids,
text is composed (NFC) and lower-cased, split by the file's pattern, and mapped to
byte-level symbols.  Texts whose code points all lie below U+0300 (where composing changes
nothing) are prepared here; others by the library's own normalizer and splitter.

Edge cases: null or empty text gives no ids, n_tokens 0 and an empty decoded text.  Rows are
kept one to one (null or repeated doc_id too); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.words import chunks, split_words, texts_of

RUN_BYTES = 1 << 20
KNOWN_WORDS = 1 << 16  # strings and words of a generation that are kept with their ids; there are two
_WIDE = regex.compile("[^\\x00-\\u02ff]")


def byte_symbols() -> list[str]:
    """The printable character of each byte in byte-level vocabularies: printable Latin-1 bytes
    stand for themselves, the rest take the code points from 256 upward in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    def __init__(self, source: str):
        self.source, self._library = source, None
        spec = json.loads(source)
        model = spec["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([self.vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.base = len(self.vocab) + len(self.special) + 1
        keys = left * self.base + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order  # a pair's place in the file is its rank
        self.merged = np.array([self.vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        symbols = byte_symbols()
        self.inner = np.array([self.vocab[s] for s in symbols], np.int64)
        self.last = np.array([self.vocab[s + self.end] for s in symbols], np.int64)
        self.of_symbol = {s: bytes([b]) for b, s in enumerate(symbols)}
        every = range(max(self.token, default=-1) + 1)
        self.decimal = pa.array([b"%d " % i for i in every], pa.large_binary())
        self.shown = pa.array([self.token.get(i, "").encode() + b" " for i in every], pa.large_binary())
        self.known: dict[str, tuple[bytes, bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes, bytes]] = {}

    @property
    def library(self):
        """The library's own tokenizer, loaded when the first text needs its normalizer."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        return self._library

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces (each a word's bytes), one after the other, and how many each has."""
        size = np.array([len(p) for p in pieces])
        symbols = self.inner[np.frombuffer(b"".join(pieces), np.uint8)]
        ends = np.cumsum(size)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        symbols[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(pieces)), size)
        ready: list[tuple[np.ndarray, np.ndarray]] = []  # (word, symbol) of words that are done
        none, rank = len(self.merged), np.empty(len(symbols), np.int64)  # rank: of a symbol and its right neighbour
        changed = np.arange(len(symbols))
        while len(symbols):
            right = np.minimum(changed + 1, len(symbols) - 1)
            inner = (word[right] == word[changed]) & (right > changed)
            pair = np.where(inner, symbols[changed] * self.base + symbols[right], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank[changed] = np.where(self.keys[at] == pair, self.ranks[at], none)
            heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, heads)
            length = np.diff(np.r_[heads, len(symbols)])
            least = np.repeat(best, length)
            done = least == none
            ready.append((word[done], symbols[done]))
            hit = (rank == least) & ~done
            # in a run of adjacent hits (a pair of two equal symbols) every second one merges
            place = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1]], place, 0))
            hit &= (place - run) % 2 == 0
            symbols[hit] = self.merged[rank[hit]]
            left = ~(np.r_[False, hit[:-1]] | done)
            symbols, word, rank, hit = symbols[left], word[left], rank[left], hit[left]
            changed = np.flatnonzero(hit | np.r_[hit[1:], False])  # merged symbols and those before them
        words, ids = (np.concatenate([r[k] for r in ready]) for k in (0, 1))
        return ids[np.argsort(words, kind="stable")], np.bincount(words, minlength=len(pieces))

    def render(self, ids: np.ndarray, count: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
        """Entries of words with so many ids each: slices of three byte strings."""
        columns = []
        for forms in (self.decimal, self.shown):
            data, at = texts_of(forms.take(pa.array(ids)))
            columns.append((data.tobytes(), at))
        columns.append((ids.astype(np.int32).tobytes(), np.arange(len(ids) + 1) * 4))
        ends = np.concatenate([[0], np.cumsum(count)])
        cuts = [at[ends].tolist() for _, at in columns]
        return list(zip(*[[raw[a:b] for a, b in zip(c[:-1], c[1:], strict=True)] for (raw, _), c in zip(columns, cuts, strict=True)], strict=True))

    def pieces(self, text: str) -> list[str]:
        """Words before byte mapping; a special token stands for itself."""
        if "<" in text and self.at_special.search(text):
            return [p for part in self.at_special.split(text) if part for p in ([part] if part in self.special else self.pieces(part))]
        if not _WIDE.search(text):
            return self.split.findall(text.lower())
        shown = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [b"".join(map(self.of_symbol.__getitem__, p)).decode() for p, _ in shown]

    def encode(self, strings: list[str]) -> list[tuple[bytes, bytes, bytes]]:
        """Of each string its ids in decimal and its tokens, each followed by a space, and its ids as int32."""
        known, older = self.known, self.older
        out = [known.get(s) for s in strings]
        rest: list[tuple[int, list[str]]] = []  # strings that are not known yet, as words
        new: dict[str, None] = {}
        for k, entry in enumerate(out):
            if entry is None:
                s = strings[k]
                entry = out[k] = older.get(s)
                if entry is not None:
                    known[s] = entry
                    continue
                words = [s] if s.isascii() and s.isalpha() and s.islower() else self.pieces(s)
                rest.append((k, words))
                for p in words:
                    if p not in known:
                        entry = older.get(p)
                        if entry is None:
                            new[p] = None
                        else:
                            known[p] = entry
        plain = [p for p in new if p not in self.special]
        if plain:
            known.update(zip(plain, self.render(*self.merge([p.encode() for p in plain])), strict=True))
        for p in new:
            if p in self.special:
                known[p] = self.render(np.array([self.special[p]]), np.array([1]))[0]
        for k, words in rest:
            if len(words) == 1:
                entry = known[words[0]]
            else:
                parts = [known[p] for p in words]
                entry = (b"".join([x[0] for x in parts]), b"".join([x[1] for x in parts]), b"".join([x[2] for x in parts]))
            out[k] = known[strings[k]] = entry
        if len(known) > KNOWN_WORDS:
            self.known, self.older = {}, known
        return out

    def forget(self) -> None:
        self.known, self.older = {}, {}

    def encode_run(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[pa.Array], np.ndarray]:
        """Texts given as UTF-8 bytes and offsets: the place of each one's first string (and the end); decimals,
        tokens and ids (int32 bytes) string by string; and the number of ids before each text (and of all)."""
        words = split_words(data, at)
        size = words.end - words.start
        inside = np.zeros(len(data) + 1, np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = pa.py_buffer(np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]))
        strings = pa.Array.from_buffers(pa.large_string(), len(size), [None, pa.py_buffer(ends), flat]).dictionary_encode()
        entries = self.encode(strings.dictionary.to_numpy(zero_copy_only=False).tolist())
        columns = [pa.array([e[k] for e in entries], pa.large_binary()).take(strings.indices) for k in range(3)]
        count = np.concatenate([[0], np.cumsum(np.array([len(e[2]) // 4 for e in entries], np.int64)[strings.indices.to_numpy()])])
        return words.first, columns, count[words.first]


_loaded: dict[str, Bpe] = {}


def _joined(strings: pa.Array, first: np.ndarray) -> list[memoryview]:
    """Each text's bytes, without the space after its last one."""
    data, at = texts_of(strings)
    raw, at = memoryview(data), at[first]
    return [raw[a : max(a, b - 1)] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _run(source, digest: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(source.value.encode()).hexdigest()
        bpe = _loaded.get(key) or _loaded.setdefault(key, Bpe(source.value))  # once per worker, not per task
        try:
            for batch in batches:
                data, at = texts_of(batch["text"])
                for i, j in chunks(at, RUN_BYTES):
                    first, (decimals, tokens, ids), before = bpe.encode_run(data[at[i] : at[j]], at[i : j + 1] - at[i])
                    out = {c: batch[c][i:j] for c in keep} | {"n_tokens": pa.array(np.diff(before), pa.int64())}
                    shown, numbers = _joined(tokens, first), _joined(decimals, first)
                    if not digest:
                        flat, _ = texts_of(ids)
                        out["ids"] = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(np.frombuffer(flat.tobytes(), np.int32)))
                        out["decoded"] = pa.array([str(x, "utf-8") for x in shown], pa.string())
                    out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in numbers], pa.string())
                    out["decoded_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in shown], pa.string())
                    yield pa.RecordBatch.from_pydict(out)
        finally:
            bpe.forget()  # an idle worker holds no words, and no memory beside its tables
            pa.default_memory_pool().release_unused()

    return run


def read_vocabulary(path: str) -> str:
    """The tokenizer file's text, read by the driver (its size does not depend on the corpus)."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """doc_id, n_tokens, [ids array<int>, decoded,] ids_sha256, decoded_sha256 for every row."""
    source = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    rest = "" if digest else "ids array<int>, decoded string, "
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _run(source, digest, ["doc_id"]), f"doc_id {kind}, n_tokens long, {rest}ids_sha256 string, decoded_sha256 string")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that the ids stand for (tokens joined by a space; the file names no decoder)."""
    source = encoded.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(source.value.encode()).hexdigest()
        token = (_loaded.get(key) or _loaded.setdefault(key, Bpe(source.value))).token
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "decoded": pa.array(
                [" ".join([token[i] for i in ids or () if i in token]) for ids in batch["ids"].to_pylist()], pa.string())})

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, decoded string")
