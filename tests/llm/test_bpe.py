import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from postloom.llm import bpe
from postloom.llm.bpe import bpe_decode, bpe_encode

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_equals_the_library(spark, library):
    r = random.Random(1)
    signs = list("aA bB'sZzéÉİΣσςe\n\t\x1c\x85\xa0½²١٣一二ß!?<|>_#日本ﬁǅ​😀") + ["é", "<|endoftext|>", "<|startoftext|>", "'ll", "123", "aaaa", "there"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 50))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in bpe_encode(df, PATH).collect()}
    for i, e in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        x, plain = got[i], library.decode(e.ids, skip_special_tokens=False)
        assert (x.ids, x.n_tokens, x.decoded) == (e.ids, len(e.ids), plain), texts[i]
        assert (x.ids_sha256, x.decoded_sha256) == (sha(" ".join(map(str, e.ids))), sha(plain))
    back = {x.doc_id: x.decoded for x in bpe_decode(bpe_encode(df, PATH), PATH).collect()}
    assert back == {i: x.decoded for i, x in got.items()}


def test_known_words_may_be_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN_WORDS", 3)
    b = bpe.Bpe(bpe.read_vocabulary(PATH))
    for text in ("one two three four five", "six one seven", "one two aaaaaaa", "one", "two one"):
        entries = b.encode(text.split())
        want = library.encode(text, add_special_tokens=False)
        assert b"".join(e[0] for e in entries) == "".join(f"{i} " for i in want.ids).encode()
        assert len(b.known) <= 8 and len(b.older) <= 8  # a generation, and the strings of one call


def test_edges(edge_docs, no_docs, clashing_docs, rows_of, library):
    got = rows_of(bpe_encode(edge_docs, PATH, digest=True))
    assert got == rows_of(bpe_encode(clashing_docs, PATH, digest=True)) and len(got) == edge_docs.count()
    want = sorted(((r.doc_id, len(e := library.encode(r.text or "", add_special_tokens=False).ids), sha(" ".join(map(str, e))),
                    sha(library.decode(e, skip_special_tokens=False))) for r in edge_docs.collect()), key=repr)
    assert got == want
    assert rows_of(bpe_encode(no_docs, PATH)) == []
