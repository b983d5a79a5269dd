"""Ids and counts against the public libraries."""

import base64
import hashlib
import random
from array import array

import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from netquarry.llm import bpe, pretokens, tokens


def texts():
    rng = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "é", "😀", "1", "٣", "'s", "'LL", "!", "\t", "　", "ß", "中", "‍", "<|endoftext|>"]
    out = [None, "", "a" * 3000, " " * 2000 + "x", "ab" * 1500, "<|endoftext|> hi<|endoftext|>", "\u0085 x \x00"]
    out += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    out += ["".join(chr(c) for c in (rng.randrange(0x110000) for _ in range(20)) if not 0xD800 <= c < 0xE000) for _ in range(300)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts())) * 2
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string")


def test_ids_equal_the_library_and_decode_to_the_text(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.RANK_FILE), "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.encode(docs, ids=True).collect()
    want = dict(enumerate(texts()))
    assert len(got) == 2 * len(want)
    for r in got:
        ids = own.encode_ordinary(want[r.doc_id] or "")
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((want[r.doc_id] or "").encode()).hexdigest()


def test_counts_equal_the_library(docs):
    library = Tokenizer.from_file(P.path(tokens.MODEL_FILE))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts())}
    got = tokens.count_tokens(docs, limit=40).collect()
    assert len(got) == 2 * len(want)
    for r in got:
        text = texts()[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (want[r.doc_id], len(text.encode()), want[r.doc_id] > 40)


def test_leftmost_only_merging_gives_the_same_counts():
    a, b = tokens.Ragged(P.path(tokens.MODEL_FILE)), tokens.Ragged(P.path(tokens.MODEL_FILE))
    assert a.together
    b.together = False
    words = [w.encode() for w in {p for t in texts() if t for p in pretokens.PIECES.findall(t[:200])}]
    assert a.counts(words).tolist() == b.counts(words).tolist()


def test_latin_texts_are_cut_alike():
    rng = random.Random(5)
    for _ in range(20_000):
        text = "".join(chr(rng.choice([rng.randrange(256), rng.randrange(128), 32, 10, 39, 115, 116])) for _ in range(rng.randint(0, 30)))
        assert pretokens.pieces(text) == pretokens.PIECES.findall(text)
    assert pretokens.pieces("é 中") == ["é", " 中"]


def test_memory_starts_anew():
    memory = pretokens.Memory(most=5)
    memory.learn(["abc", "def"], lambda new: [len(x) for x in new])
    assert memory["abc"] == 3
    memory.trim()
    assert not memory and memory.held == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty).collect() == [] and tokens.count_tokens(empty).collect() == []
