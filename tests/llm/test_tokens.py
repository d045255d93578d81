"""Token counts against the library on whole texts, and the splice on texts made to break it."""

import json
import random

import public_tokenizers
import pytest
from cases import docs, none
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mirrorloom.llm import queries, token_count

PATH = public_tokenizers.path("byte_bpe_50k.json")
WHOLE = Tokenizer.from_file(PATH)
OWN = token_count.load(open(PATH, encoding="utf-8").read())
PARTS = [" ", "  ", "\n", "\n\n", "   ", "a", "the", " thing", "don't", "'s", "1", "23", "!!!", "<|endoftext|>", "<|", "é", "日本", "\U0001f600", "\t", "%%%", "x" * 30, " " * 90, "!" * 150]


def whole(t):
    return len(WHOLE.encode(t, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=200), st.sampled_from([100, 150, 300]), st.sampled_from([4, 16, 70]))
def test_splice(parts, chunk, overlap):
    t = "".join(parts)
    assert token_count.count_huge(OWN, t, chunk, overlap) == whole(t)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=900), st.sampled_from([100, 130]))
def test_splice_of_any_text(t, chunk):
    assert token_count.count_huge(OWN, t, chunk, 8) == whole(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.lists(st.sampled_from([*PARTS, "\u00a0", "\u2003", "\x1c", "\x85", " '", " 's", " <|endoftext|> ", " \u0301", "²"]), max_size=30).map("".join)), max_size=8), st.sampled_from([0, 20, 1 << 20]))
def test_words_between_boundaries(texts, most):
    words = token_count.Words(OWN, most)
    for _ in range(2):
        assert words.count(texts) == [whole(t) for t in texts]


def test_each_different_word_is_encoded_once():
    class Counted:
        seen = 0

        def encode_batch_fast(self, texts, **options):
            self.seen += sum(map(len, texts))
            return OWN.encode_batch_fast(texts, **options)

    counted, texts = Counted(), ["these are the words of a text " * 200] * 50
    assert token_count.Words(counted).count(texts) == [whole(t) for t in texts]
    assert counted.seen < 1000


def test_added_tokens_with_spaces_are_refused():
    for change in ({"rstrip": True}, {"content": "a b"}):
        told = json.loads(open(PATH, encoding="utf-8").read())
        told["added_tokens"][0] |= change
        with pytest.raises(ValueError, match="spaces"):
            token_count.load(json.dumps(told))


def test_one_piece_longer_than_a_chunk():
    for t in ("x" * 1000, " " * 1000, "!" * 999, "a" + " " * 500 + "b" * 500, "<|endoftext|>" * 100, ""):
        assert token_count.count_huge(OWN, t, 100, 16) == whole(t)


def test_documents(spark):
    df = docs(spark, [(9000, "".join(random.Random(1).choices(PARTS, k=30_000)))])
    out = token_count.count_tokens(df, PATH)
    assert out.columns == df.columns + ["n_tokens"]
    assert sorted((str(r.doc_id), r.n_tokens) for r in out.collect()) == sorted((str(r.doc_id), whole(r.text or "")) for r in df.collect())
    assert token_count.count_tokens(none(spark), PATH).count() == 0


def test_query(spark, small):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op8_token_count(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        n = whole(r.text)
        assert got[r.doc_id] == (len(r.text.encode()), n, n > 512)
