from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docspark.llm import token_counts as tc

PATH = tc.vocabulary_path()
LIBRARY = Tokenizer.from_file(PATH)


def library(text: str) -> int:
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab e'lst\n\t\u00a0\x1c1é😀.!")) , max_size=40) | st.text(max_size=30))
def test_counts_equal_the_library(text):
    assert tc.counter(PATH)(text) == library(text)


def test_special_strings_and_long_pieces():
    for text in ("a<|endoftext|>b <|endoftext|> <|endoftext|>", "<|endoftext|>", "x" * 20_000, "ab" * 5000, "  a  b \n\n c"):
        assert tc.counter(PATH)(text) == library(text)


def test_table(spark, odd_docs, no_docs):
    got = tc.count_tokens(odd_docs).collect()
    assert len(got) == 9
    for r, (i, text) in zip(got, [(x["doc_id"], x["text"] or "") for x in odd_docs.collect()]):
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (i, len(text.encode()), library(text), library(text) > 1024)
    assert tc.count_tokens(no_docs).count() == 0
