import itertools
import os

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import rows
from tidegrid.llm import bytepairs, tokens, words

FOLDER = "/root/testdata/sf0.001"
JSON = f"{tokens.VOCABULARIES}/byte_bpe_50k.json"
MULTI = f"{tokens.VOCABULARIES}/byte_bpe_multi_50k.tiktoken"


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def own():
    return bytepairs.BatchEncoder(bytepairs.TokenAutomaton(*tokens.vocabulary(tokens.BYTE_BPE_50K)))


EDGES = ["", " ", "  a  b ", "they're 'solve 's ''s we'LL", "\n\n x\r\n", "a" * 3000, " " * 500 + "x", "日本語 123４５ ①é̀", "<|endoftext|>", "\x1c\x85\xa0　 z", "👩‍👩‍👧‍👦'm", "Ã©﻿\xad"]


def test_edges(own, public):
    assert own.encode(pa.array(EDGES)).to_pylist() == public(EDGES)
    assert own.counts(pa.array(EDGES)).tolist() == [len(x) for x in public(EDGES)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\t'strvemldaAbBéÄ日1٣.,-\" 👍")), max_size=40), min_size=1, max_size=5))
def test_random_texts(own, public, texts):
    got = own.encode(pa.array(texts)).to_pylist()
    assert got == public(texts)
    assert [own.automaton.decode(ids).decode() for ids in got] == texts


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_starts_are_those_of_the_pattern(text):
    raw = text.encode("utf-8", "ignore")
    text = raw.decode()
    (offsets, data, _) = next(words.text_slices(pa.array([text])))
    starts = words.gpt_word_starts(data, offsets).tolist()
    assert [raw[a:z].decode() for a, z in zip(starts, [*starts[1:], len(raw)])] == bytepairs.split_words(text)


def merged(word, merges):
    """Byte-pair encoding by its definition: the first merge in order that occurs, leftmost first, again and again."""
    parts = list(word)
    for u, v, w in merges:
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and (parts[i], parts[i + 1]) == (u, v):
                out.append(w)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000))
def test_gadgets_against_the_definition(seed):
    import random

    rng = random.Random(seed)
    names, merges = [b"a", b"b"], []
    while len(merges) < 6:
        u, v = rng.randrange(len(names)), rng.randrange(len(names))
        if names[u] + names[v] not in names:
            merges.append((u, v, len(names)))
            names.append(names[u] + names[v])
    automaton = bytepairs.TokenAutomaton(names, merges)
    for n in range(1, 9):
        for word in itertools.product((0, 1), repeat=n):
            text = b"".join(names[i] for i in word)
            path = automaton.encode(text)
            assert path == merged(word, merges) and automaton.decode(path) == text


def test_ranks_give_the_listed_merges():
    import json

    with open(JSON) as f:
        listed = json.load(f)["model"]["merges"]
    assert len(tokens.vocabulary(tokens.BYTE_BPE_50K)[1]) == len(listed)


def test_other_vocabulary():
    import base64

    import tiktoken

    with open(MULTI, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    other = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    own = bytepairs.BatchEncoder(bytepairs.TokenAutomaton(*tokens.vocabulary(MULTI)))
    texts = [*EDGES, "Der Hof verlor das Tor im Mai. L'assureur a reporté le rapport d'expertise."]
    assert own.encode(pa.array(texts)).to_pylist() == [other.encode_ordinary(t) for t in texts]


def test_slices_and_full_tables(public, monkeypatch):
    monkeypatch.setattr(words, "text_slices", lambda column, limit=50, f=words.text_slices: f(column, 50))
    monkeypatch.setattr(bytepairs.BatchEncoder, "MOST_WORDS", 5)
    own = bytepairs.BatchEncoder(bytepairs.TokenAutomaton(*tokens.vocabulary(tokens.BYTE_BPE_50K)))
    texts = ["the quick brown fox %d jumps" % i for i in range(40)] + [None, "", "x" * 120]
    assert own.encode(pa.array(texts)).to_pylist() == public([t or "" for t in texts])


def test_corpus(spark, public):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    assert got == dict(zip(texts, public([t or "" for t in texts.values()])))
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    back = tokens.decode_corpus(tokens.encode_corpus(docs))
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {k: t or "" for k, t in texts.items()}


def test_null_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "a", 1), (2, "", "b", 2), (2, "hello", None, 3), (None, "hello hello", "c", 4)], "doc_id bigint, text string, ids string, n_tokens int")
    assert rows(tokens.encode_corpus(df)) == sorted([(1, []), (2, []), (2, [31373]), (None, [31373, 23748])], key=str)
    assert rows(tokens.count_tokens(df)) == sorted([(1, 0), (2, 0), (2, 1), (None, 2)], key=str)
    assert tokens.encode_corpus(df.filter("false")).count() == 0
    assert os.path.exists(tokens.BYTE_BPE_50K)
