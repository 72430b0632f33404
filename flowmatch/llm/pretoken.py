"""Vectorised pre-tokeniser for the pattern ``public_tokenizers.PATTERN``.

The pattern cuts a text at changes of character class (letter, number, white
space, other), lets one space join the run after it, keeps all but the last
character of a white-space run that something follows, and cuts the
contractions 's 't 're 've 'm 'll 'd.  The same cuts are found here for a
whole batch at once with numpy, many times faster than by a regular
expression; ``tests/llm`` compares the two on random texts.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

LETTER, NUMBER, OTHER, WHITE, END = 0, 1, 2, 3, 4
# Unicode White_Space, the meaning of \s in the tokenizer libraries.
WHITE_SPACE = ("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
_END_CODE = 0x110000
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point; one more entry marks the end of a text."""
    out = np.full(_END_CODE + 1, OTHER, np.uint8)
    for c in range(_END_CODE):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[ord(c) for c in WHITE_SPACE]] = WHITE
    out[_END_CODE] = END
    return out


def _bounds(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts as one UTF-8 buffer, byte start and stop of every pre-token,
    and the number of pre-tokens of each text."""
    whole = "\0".join(texts) + "\0"
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    codes[ends] = _END_CODE
    n = len(codes)
    cls = classes()[codes]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(cls[1:], cls[:-1], out=start[1:])

    # The last character of a white-space run stands apart if a text goes on after it.
    last = np.zeros(n, bool)
    white = cls == WHITE
    last[:-1] = white[:-1] & ~white[1:] & (cls[1:] != END)
    start |= last
    # A single space joins the run after it.
    start[1:] &= ~(last[:-1] & (codes[:-1] == 32))
    # Contractions: a lone apostrophe at a token's start, then letters.
    quote = np.flatnonzero(start[:-1] & (codes[:-1] == 39) & (cls[1:] == LETTER))
    if len(quote):
        padded = np.append(codes, np.full(3, _END_CODE, np.uint32))
        a, b = padded[quote + 1], padded[quote + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((b == ord("e")) & np.isin(a, [ord("r"), ord("v")])) | ((a == ord("l")) & (b == ord("l")))
        for found, size in ((one, 2), (two, 3)):
            at = quote[found]
            start[at + 1] = False
            start[at + size] = True
    start[ends] = True
    at = np.flatnonzero(start)
    is_end = cls[at] == END
    counts = np.diff(np.flatnonzero(is_end), prepend=-1) - 1
    stop = np.append(at[1:], n)
    keep = ~is_end
    at, stop = at[keep], stop[keep]
    utf8 = whole.encode("utf-8", "surrogatepass")
    if len(utf8) > n:  # code point offsets to byte offsets
        codes[ends] = 0
        more = np.zeros(n + 1, np.int32)
        width = (codes >= 0x80).view(np.int8)
        if len(utf8) > n + np.count_nonzero(width):
            width = width + (codes >= 0x800).view(np.int8) + (codes >= 0x10000).view(np.int8)
        np.cumsum(width, out=more[1:])
        at, stop = at + more[at], stop + more[stop]
    return utf8, at, stop, counts


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``np.unique``: a place of each distinct value, and each value's index."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return order[new], inverse


def cut(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the index into them of every pre-token in order,
    and how many pre-tokens each text has.

    Pre-tokens of up to 16 bytes are held as two 64-bit numbers, so that
    equal ones are found by a sort of numbers; longer ones go through a dict.
    """
    if not texts:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int64)
    utf8, at, stop, counts = _bounds(texts)
    buffer = np.frombuffer(utf8 + bytes(16), np.uint8)
    eight = np.lib.stride_tricks.as_strided(buffer[:8].view("<u8"), (len(buffer) - 7,), (1,))
    size = stop - at
    short = size <= 16
    a, z = at[short], size[short]
    masks = _MASKS
    low = eight[a] & masks[np.minimum(z, 8)]
    high = eight[np.minimum(a + 8, len(eight) - 1)] & masks[np.clip(z - 8, 0, 8)]
    mixed = (low ^ (low >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (high ^ (high >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    mixed += z.astype(np.uint64)
    first, inverse = _distinct(mixed)
    if not (np.array_equal(low[first][inverse], low) and np.array_equal(high[first][inverse], high) and np.array_equal(z[first][inverse], z)):
        # two pre-tokens with one mixed number: sort by all of it
        _, first, inverse = np.unique(np.stack([low, high, z.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
        inverse = inverse.reshape(-1)
    distinct = [utf8[i:j] for i, j in zip(a[first].tolist(), (a + z)[first].tolist())]
    index = np.empty(len(at), np.int64)
    index[short] = inverse
    if not short.all():
        seen: dict[bytes, int] = {}
        rest = [seen.setdefault(utf8[i:j], len(distinct) + len(seen)) for i, j in zip(at[~short].tolist(), stop[~short].tolist())]
        index[~short] = rest
        distinct += seen
    return distinct, index, counts


def spread_out(values: np.ndarray, offsets: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the slices ``values[offsets[i]:offsets[i + 1]]`` for ``i``
    in ``index``; also the running end of each slice, with a leading zero."""
    size = (offsets[1:] - offsets[:-1])[index]
    ends = np.zeros(len(index) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    where = np.arange(ends[-1]) + np.repeat(offsets[:-1][index] - ends[:-1], size)
    return values[where], ends


def pieces(texts, limit: int = 2_000_000):
    """Lists of texts with about ``limit`` characters each; a longer text stands alone."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > limit:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part
