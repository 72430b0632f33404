import random

import numpy as np
import public_tokenizers
import regex

from flowmatch.llm import pretoken

PARTS = ["a", "b", "s", "t", "re", "ve", "ll", "m", "d", "'", "'s", "'ll", "'ve", " ", "  ", "\n", "\t", "\xa0", "1", "²", "é", "!", "|",
         "中", " ", "'S", "\x1c", "😀", "́", "A", "\0", "abcdefghijklmnopqrst"]


def test_cuts_like_the_pattern():
    rx, rnd = regex.compile(public_tokenizers.PATTERN), random.Random(1)
    for _ in range(600):
        texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 14))) for _ in range(6)]
        distinct, index, counts = pretoken.cut(texts)
        assert len(set(distinct)) == len(distinct)
        tokens = [distinct[i].decode() for i in index]
        for text, n in zip(texts, counts):
            assert tokens[:n] == rx.findall(text)
            tokens = tokens[n:]


def test_no_texts_and_empty_texts():
    assert pretoken.cut([]) [0] == []
    distinct, index, counts = pretoken.cut(["", ""])
    assert distinct == [] and len(index) == 0 and counts.tolist() == [0, 0]


def test_spread_out():
    values, ends = pretoken.spread_out(np.array([7, 8, 9]), np.array([0, 2, 2, 3]), np.array([2, 0, 1, 0]))
    assert values.tolist() == [9, 7, 8, 7, 8] and ends.tolist() == [0, 1, 3, 3, 5]
