import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.encoding import Encoder, encode_documents, token_counts, vocabulary_path, vocabulary_pattern


@pytest.fixture(scope="module")
def own():
    return Encoder(vocabulary_path(), vocabulary_pattern())


@pytest.fixture(scope="module")
def ref(own):
    return tiktoken.Encoding("ref", pat_str=vocabulary_pattern(), mergeable_ranks=own.ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("etaoin shrdlu'sé日本\n\t0123<|endoftext|>")), max_size=120))
def test_same_as_reference_library(own, ref, text):
    ids = own.encode([text])[0]
    assert ids == (ref.encode_ordinary(text) if text else [])
    assert ref.decode(ids) == text  # exact round trip


def test_long_pieces(own, ref):
    rnd = random.Random(2)
    for n in (63, 64, 65, 500, 20_000):
        t = "".join(rnd.choice("abcdetaoinshrlu日") for _ in range(n))
        assert own.encode([t])[0] == ref.encode_ordinary(t)


def test_table(spark, ref):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n", "x"), (4, "<|endoftext|>", "x"), (4, "<|endoftext|>", "x"), (5, "a b" * 40_000, "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in encode_documents(d).collect())
    assert got == sorted((i, ref.encode_ordinary(t) if t else []) for i, t, _ in rows)
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(d).collect()) == [(i, len(x)) for i, x in got]
    assert encode_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
