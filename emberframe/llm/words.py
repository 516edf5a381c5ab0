"""Vectorised tokens over Arrow text buffers: runs of letters, of digits, of other marks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from emberframe.llm.common import Texts, mix64

#: 0 white space, 1 letter (ASCII, or any byte of a non-ASCII character), 2 digit, 3 other mark.
KIND = np.full(256, 3, np.uint8)
KIND[[*range(9, 14), 32]] = 0
KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND[48:58] = 2

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

_VALUE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
#: Weight of a byte by its place in the token; places from 256 on repeat.
_PLACE = mix64(np.arange(1001, 1257, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Tokens:
    """Tokens of a run of rows; ``hash`` is 64 bits of the token's bytes, ``row`` its row."""

    start: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    _sums: np.ndarray

    def prefix(self, n: int) -> np.ndarray:
        """Hash of the first ``n`` bytes; 0 for tokens that are no longer than that."""
        ends = np.minimum(self.start + n, len(self._sums) - 1)
        return np.where(self.length > n, mix64(self._sums[ends] - self._sums[self.start] + np.uint64(n)), np.uint64(0))


def fold(data: np.ndarray) -> np.ndarray:
    """A-Z and the Latin-1 capitals (two UTF-8 bytes) as small letters."""
    out = FOLD[data]
    capital = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = capital[(data[capital] >= 0x80) & (data[capital] <= 0x9E) & (data[capital] != 0x97)]
    out[capital] += 0x20
    return out


def tokenise(texts: Texts, folded: bool) -> Tokens:
    data = fold(texts.bytes) if folded else texts.bytes
    kind = KIND[data]
    new = np.empty(len(data), bool)
    new[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=new[1:])
    firsts = texts.offsets[:-1]
    new[firsts[firsts < len(data)]] = True
    starts = np.flatnonzero(new)
    lengths = np.diff(np.append(starts, len(data)))
    place = (np.arange(len(data), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)) & 255
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * _PLACE[place], out=sums[1:])
    kinds = kind[starts]
    keep = kinds > 0
    starts, lengths, kinds = starts[keep], lengths[keep], kinds[keep]
    return Tokens(starts, lengths, kinds, np.searchsorted(texts.offsets, starts, "right") - 1, mix64(sums[starts + lengths] - sums[starts]), sums)


#: Bytes of text that ``word_hashes`` works through at once.
PIECE = 1 << 16
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True


def word_hashes(texts: Texts, folded: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a run of rows, and the n + 1 bounds of the rows in them.

    Words are runs of anything but ASCII white space, with A-Z as small letters if
    ``folded``.  Texts are worked through in pieces, also within a word, so that a
    very long one takes eight bytes a word and no more.
    """
    data, length = texts.bytes, len(texts.bytes)
    hashes, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    held, place = np.zeros(1, np.uint64), 0  # sum and length of a word that goes on in the next piece
    for a in range(0, length, PIECE):
        size = min(PIECE, length - a)
        word = np.append(~_SPACE[data[a : a + size + 1]], False)[: size + 1]
        first = np.zeros(size + 1, bool)
        first[texts.offsets[np.searchsorted(texts.offsets, a) : np.searchsorted(texts.offsets, a + size, "right")] - a] = True
        begins = word[:size] & (first[:size] | ~np.append(place > 0, word[: size - 1]))
        goes_on = word[1:] & ~first[1:]
        at = np.arange(size)
        since = np.maximum.accumulate(np.where(begins, at, -place))
        values = data[a : a + size]
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(np.where(word[:size], _VALUE[FOLD[values] if folded else values] * _PLACE[(at - since) & 255], np.uint64(0)), out=sums[1:])
        before = np.where(since < 0, np.negative(held), sums[np.maximum(since, 0)])
        stops = np.flatnonzero(word[:size] & ~goes_on)
        hashes.append(mix64(sums[stops + 1] - before[stops]))
        ends.append(stops + a)
        open_end = word[size - 1] and goes_on[-1]
        held, place = (sums[-1:] - before[-1:], int(size - since[-1])) if open_end else (np.zeros(1, np.uint64), 0)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(ends), texts.offsets)


def count_words(text: bytes) -> int:
    word = np.append(False, ~_SPACE[np.frombuffer(text, np.uint8)])
    return int((word[1:] > word[:-1]).sum())


def kept_words(text: bytes, keep: np.ndarray | None = None) -> bytes:
    """The words of a text under the mask ``keep`` (all without one), joined by one space; about ten bytes of memory a byte of text."""
    data = np.frombuffer(text + b" ", np.uint8)
    word = ~_SPACE[data]
    after = np.zeros(len(word), bool)  # the byte after each word
    np.greater(word[:-1], word[1:], out=after[1:])
    take = word | after
    if keep is not None:
        begins = word.copy()
        np.greater(word[1:], word[:-1], out=begins[1:])
        nth = np.cumsum(begins, dtype=np.int32) - 1
        take[take] &= keep[nth[take]]
    return np.where(word, data, np.uint8(32))[take][:-1].tobytes()
