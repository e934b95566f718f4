"""Ids must be those of the tokenizers library."""

from array import array

import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from forecourt.llm import chunks, tokens

PATHS = {"byte": public_tokenizers.path("byte_bpe_50k.json"), "word": public_tokenizers.path("word_bpe_49k.json")}
LIBRARY = {k: Tokenizer.from_file(p) for k, p in PATHS.items()}
TRICKY = [
    "", " ", "  a", "a  b", " a b ", "a \n b", "a\nb c", "it's don't I'LL X's 'S", "a <|startoftext|>b C", "<|endoftext|>a <|endoftext|> b<|endoftext|>",
    "İstanbul ΣΑΣ ﬁ", "😀 ab1234 5", "\t tab\tx", "a\x1cb c \x1c d", "日本 語", "x́ ́y", "ÀÉß ÿŸ µ ª", "a　b c d", "a.b, c., d.,", "word " * 500, "\r\n a\r\n",
]
PARTS = st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "é", "<|endoftext|>", "'s", "\t", " ", "日", "\x1c", ".", "12"]), max_size=60).map("".join)


def library(kind: str, text: str) -> list[int]:
    return LIBRARY[kind].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", ["byte", "word"])
def test_tricky_texts(kind):
    tokenizer = tokens.load(kind, PATHS[kind])
    for text in TRICKY:
        assert list(array("I", tokenizer.encode(text))) == library(kind, text), text


@settings(max_examples=300, deadline=None)
@given(PARTS | st.text(max_size=80))
def test_any_text(text):
    for kind in PATHS:
        assert list(array("I", tokens.load(kind, PATHS[kind]).encode(text))) == library(kind, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(PARTS, max_size=8).map("".join))
def test_chunk_joins_and_decoding(text):
    tokenizer = tokens.load("byte", PATHS["byte"])
    ids = chunks.Encoder(tokenizer).encode(text)
    assert list(array("I", ids)) == library("byte", text)
    assert tokenizer.decode(ids) == LIBRARY["byte"].decode(library("byte", text), skip_special_tokens=False)


def test_chunks_are_reused():
    import random

    rnd = random.Random(3)
    passage = " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(3000))
    tokenizer = tokens.load("byte", PATHS["byte"])
    encoder = chunks.Encoder(tokenizer)
    for i in range(10):
        text = f"Title {i}\n{passage} end {i}"
        assert encoder.encode(text) == tokenizer.direct(text)
    assert encoder.chunks_encoded < 0.2 * encoder.chunks_met
