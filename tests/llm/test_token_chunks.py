"""Chunks of the encoder: cuts at line feeds, marks and digits ask the tokenizer for each word once, and leave all ids as they are."""

import random

import numpy as np
import pyarrow as pa
import pytest

from latticework.llm import tokens

PARTS = ["a", "The", "ing", "é", "ñ", "ß", "×", "÷", "ª", "ʰ", "ǅ", "1", "9", "٣", "Ⅷ", " ", " ", " ", "\n", "\n", "\r", "\t", ".", ",", "!", "'s", "'", "’", "“", "$", "%", "***", "<|endoftext|>", "<", "|", ">", "_", " ", " ", "　", "\u0085", "\x1c", " ", "᠎", "​", "﻿", " ", "́", "日", "😀", "Ġ", "Ċ", "\x00"]


def test_words_between_marks_and_line_feeds_are_learned_once():
    first, second = [f"wort{chr(97 + k)}" for k in range(20)], [f"Satz{chr(97 + k)}" for k in range(20)]
    e = tokens.ChunkEncoder(tokens.vocabulary())
    e.encode([f"x {a}{mark}\n{b}{mark} y" for a in first for b in second for mark in ".!$"])
    assert len(e.seen) < 60  # words, marks, a line feed, x and y; 1,200 pairs of words and marks stand between spaces


@pytest.mark.parametrize("limit", [3, 400_000])
def test_ids_are_those_of_whole_texts(reference_ids, limit):
    chance = random.Random(3)
    e = tokens.ChunkEncoder(tokens.vocabulary(), limit=limit)
    for _ in range(5):
        texts = ["".join(chance.choices(PARTS, k=chance.randint(0, n))) for n in (3, 12, 60) for _ in range(200)]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [reference_ids(t) for t in texts]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_arrays_may_be_slices_with_nulls(reference_ids, kind):
    texts = ["before", None, "", "One two.\nThree", " ", None, "x", "after"]
    e = tokens.ChunkEncoder(tokens.vocabulary())
    ids, at = e.encode_array(pa.array(texts, kind).slice(1, 6), 2)
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [[*reference_ids(t), 2] for t in texts[1:7]]
    for none in (pa.array([], kind), pa.array([None, ""], kind)):
        ids, at = e.encode_array(none)
        assert len(ids) == 0 and at.tolist() == [0] * (len(none) + 1)
