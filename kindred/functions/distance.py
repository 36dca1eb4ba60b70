"""String similarities Spark has no built-in for, computed on Arrow batches with numpy.

The kernels work on whole batches of pairs, one numpy step per character position. Only the LCS of
texts over 64 characters goes pair by pair, with Python's integers as bit vectors of any width; if
a least length is asked for, it stops as soon as that is out of reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

_CELLS = 1 << 21  # matrix cells per numpy step; bounds the memory of a batch with long strings


def _chunks(lengths: np.ndarray):
    """Index slices of similar length whose padded matrices stay small."""
    order = np.argsort(lengths, kind="stable")
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * int(lengths[order[stop]]) <= _CELLS:
            stop = min(len(order), start + 2 * (stop - start))
        while stop - start > 1 and (stop - start) * int(lengths[order[stop - 1]]) > _CELLS:
            stop = start + (stop - start) // 2
        yield order[start:stop]
        start = stop


# --- longest common subsequence (code points) -----------------------------------------------

def _codes(strings: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, strings), np.int64, len(strings))
    width = max(1, int(lengths.max(initial=0)))
    codes = np.array(strings, dtype=f"<U{width}").view(np.uint32).reshape(len(strings), width)
    return np.where(np.arange(width) < lengths[:, None], codes, np.uint32(pad)), lengths


_STEP = 64  # characters between two looks at what is still within reach


def _places(pattern: str) -> dict[str, int]:
    """Per character, the bits of its positions."""
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | (1 << i)
    return where


def _lcs_long(pattern: str, text: str, where: dict[str, int] | None = None, least: int = 0) -> int:
    """Bit-parallel LCS (Hyyro 2004) on Python integers, for patterns over 64 characters. Less than
    ``least``, but not the true length, if that cannot be reached."""
    where = _places(pattern) if where is None else where
    size, left = len(pattern), len(text)
    full = row = (1 << size) - 1
    find = where.get
    for start in range(0, left, _STEP):
        for ch in text[start : start + _STEP]:
            here = find(ch)
            if here:
                hit = row & here
                row = (row + hit) | (row - hit)
        row &= full  # carries past the end mean nothing
        matched = size - row.bit_count()
        if matched + left - start - _STEP < least:
            return matched
    return size - row.bit_count()


def _common_ends(a: str, b: str) -> tuple[int, int]:
    """Length of the common front, and of the common back of what is left."""
    n, low, high = min(len(a), len(b)), 0, min(len(a), len(b))
    while low < high:  # equal fronts are compared as a whole
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle] == b[:middle] else (low, middle - 1)
    front, low, high = low, 0, n - low
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[len(a) - middle :] == b[len(b) - middle :] else (low, middle - 1)
    return front, low


def indel_reaches(texts: list[str], other: str, threshold: float) -> np.ndarray:
    """Which texts have an Indel ratio of at least ``threshold`` with ``other``; scores that are out of
    reach are not worked out."""
    out = np.zeros(len(texts), bool)
    where = None
    near = []
    for i, text in enumerate(texts):
        total = len(text) + len(other)
        if min(len(text), len(other)) <= 64:
            near.append(i)
            continue
        # the score's own rounding decides at the limit, so the least length is taken one lower
        least = int(threshold * total / 200.0) - 1
        if min(len(text), len(other)) < least:
            continue
        front, back = _common_ends(text, other)
        if front + back:
            a, b = text[front : len(text) - back], other[front : len(other) - back]
            common = front + back + (_lcs_long(a, b, None, least - front - back) if a and b else 0)
        else:
            where = _places(other) if where is None else where
            common = _lcs_long(other, text, where, least)
        out[i] = 200.0 * common / total >= threshold
    if near:
        out[near] = indel_ratios([texts[i] for i in near], [other] * len(near)) >= threshold
    return out


def _lcs_short(patterns: list[str], texts: list[str]) -> np.ndarray:
    """The same recurrence, one 64-bit word per pair, all pairs of the slice at once."""
    left, m = _codes(patterns, 0xFFFFFFFE)
    right, _ = _codes(texts, 0xFFFFFFFF)
    n, width = left.shape
    row = np.full(n, ~np.uint64(0))
    bits = np.zeros((n, 8), np.uint8)
    used = (width + 7) // 8
    for j in range(right.shape[1]):
        bits[:, :used] = np.packbits(left == right[:, j, None], axis=1, bitorder="little")
        hit = row & bits.view("<u8")[:, 0]
        row = (row + hit) | (row - hit)
    inside = np.where(m >= 64, ~np.uint64(0), (np.uint64(1) << (m % 64).astype(np.uint64)) - np.uint64(1))
    return np.bitwise_count(~row & inside).astype(np.int64)


class ShortTexts:
    """Texts of at most 64 code points, laid out once as a word of bits per text and character, for the
    same recurrence of one text against many of them."""

    def __init__(self, texts: list[str]):
        chars, self.lengths = _codes(texts, 0xFFFFFFFE)
        if len(texts) and chars.shape[1] > 64:
            raise ValueError("These texts have at most 64 characters.")
        bits = np.zeros((len(texts), 8), np.uint8)
        used = (chars.shape[1] + 7) // 8
        self.where: dict[str, np.ndarray] = {}
        for code in np.unique(chars).tolist():
            if code != 0xFFFFFFFE:
                bits[:, :used] = np.packbits(chars == code, axis=1, bitorder="little")
                self.where[chr(code)] = bits.view("<u8")[:, 0].copy()
        self.inside = np.where(
            self.lengths >= 64, ~np.uint64(0), (np.uint64(1) << (self.lengths % 64).astype(np.uint64)) - np.uint64(1)
        )

    def ratios(self, text: str, index: np.ndarray) -> np.ndarray:
        """``indel_ratios`` of the texts at ``index`` with ``text``, which may have any length."""
        row = np.full(len(index), ~np.uint64(0))
        for ch in text:
            places = self.where.get(ch)
            if places is not None:
                hit = places[index]
                hit &= row
                row = (row + hit) | (row - hit)
        common = np.bitwise_count(~row & self.inside[index]).astype(np.int64)
        total = self.lengths[index] + len(text)
        return np.where(total == 0, 100.0, 200.0 * common / np.maximum(total, 1))

    def reaches(self, text: str, index: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``index`` have a ratio of at least ``threshold`` with ``text``."""
        return index[self.ratios(text, index) >= threshold]


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b)]
    out = np.zeros(len(pairs), np.int64)
    short = np.fromiter((len(x) for x, _ in pairs), np.int64, len(pairs))
    long = np.fromiter((len(y) for _, y in pairs), np.int64, len(pairs))
    wide = short > 64
    for i in np.flatnonzero(wide):
        out[i] = _lcs_long(*pairs[i])
    narrow = np.flatnonzero(~wide & (short > 0))
    for part in _chunks(np.maximum(long[narrow], 64)):
        index = narrow[part]
        out[index] = _lcs_short([pairs[i][0] for i in index], [pairs[i][1] for i in index])
    return out


def indel_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """200 * LCS / (len a + len b); two empty strings score 100."""
    total = np.fromiter((len(x) + len(y) for x, y in zip(a, b)), np.int64, len(a))
    return np.where(total == 0, 100.0, 200.0 * lcs_lengths(a, b) / np.maximum(total, 1))


@arrow_udf(DoubleType())
def indel_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Score of each pair; a null side (a pair already decided) costs nothing and stays null."""
    known = np.asarray(a.is_valid()) & np.asarray(b.is_valid())
    keep = pa.array(known)
    scores = np.zeros(len(a))
    if known.any():
        scores[known] = indel_ratios(a.filter(keep).to_pylist(), b.filter(keep).to_pylist())
    return pa.array(scores, mask=~known)


# --- Levenshtein distance (code points) --------------------------------------------------------

_WORD = 63               # text bits in a word; the top bit takes the carry of a sum
_LANE_WORDS = 8_192      # words worked on at once; what fits a core's cache
_WAVE_WORDS = 4_096      # fewer are not worth a step of their own
_WAVE = 16               # so that many others are taken together at most
_LETTERS = 32            # counts of characters kept per text
_PLACES_WORDS = 1 << 23  # words of remembered places, 64 MB


class EditTexts:
    """Texts as words of bits, whose Levenshtein distances to others are found many at a time (Myers
    1999, Hyyro 2003): a few numpy steps per character of the other text, whatever the texts' lengths."""

    def __init__(self, texts: list[str]):
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words = self.lengths // _WORD + 1  # at least one spare bit, so that no carry leaves a text
        self.starts = np.cumsum(self.words) - self.words
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        at = np.arange(len(self.codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.word = np.repeat(self.starts, self.lengths) + at // _WORD
        self.bit = np.uint64(1) << (at % _WORD).astype(np.uint64)
        self.by_code = np.argsort(self.codes, kind="stable")
        self.sorted_codes = self.codes[self.by_code]
        self.total = int(self.words.sum())
        self.inside = np.zeros(self.total, np.uint64)
        np.bitwise_or.at(self.inside, self.word, self.bit)
        self.places: dict[int, np.ndarray] = {}
        own = np.repeat(np.arange(len(texts)) * _LETTERS, self.lengths)
        letters = np.bincount(own + self.codes % _LETTERS, minlength=len(texts) * _LETTERS)
        self.letters = letters.reshape(len(texts), _LETTERS)

    def together(self, index: np.ndarray) -> int:
        """How many others to compare with the texts at ``index`` at once."""
        return int(np.clip(_WAVE_WORDS // max(1, int(self.words[index].sum())), 1, _WAVE))

    def reaches(self, others: list[str], index: np.ndarray, threshold: float) -> np.ndarray:
        """Whether 100 * (1 - edits / length of the longer text) reaches the threshold: one row per other
        text, one column per ``index``. Two empty texts score 100."""
        lengths = np.fromiter(map(len, others), np.int64, len(others))[:, None]
        longest = np.maximum(lengths, self.lengths[index])
        most = np.floor(longest * (100.0 - threshold) / 100.0 + 1e-9)
        possible = np.abs(lengths - self.lengths[index]) <= most
        for i, other in enumerate(others):  # a character the other has not must be edited
            codes = np.frombuffer(other.encode("utf-32-le"), np.uint32) % _LETTERS
            shared = np.minimum(self.letters[index], np.bincount(codes, minlength=_LETTERS)).sum(axis=1)
            possible[i] &= longest[i] - shared <= most[i]
        at = np.flatnonzero(possible.any(axis=0))
        out = np.zeros(possible.shape, bool)
        if len(at):
            out[:, at] = self.distances(others, index[at]) <= most[:, at]
        return out

    def _places(self, code: int) -> np.ndarray:
        found = self.places.get(code)
        if found is None:
            if len(self.places) * self.total > _PLACES_WORDS:
                self.places.clear()
            found = np.zeros(self.total, np.uint64)
            here = self.by_code[slice(*np.searchsorted(self.sorted_codes, [code, code + 1]))]
            np.bitwise_or.at(found, self.word[here], self.bit[here])
            self.places[code] = found
        return found

    def distances(self, others: list[str], index: np.ndarray) -> np.ndarray:
        """One row per other text, one column per ``index``."""
        out = np.empty((len(others), len(index)), np.int64)
        order = sorted(range(len(others)), key=lambda i: -len(others[i]))
        used = np.cumsum(self.words[index])
        most = max(1, _LANE_WORDS // max(1, len(others)))
        start = 0
        while start < len(index):
            done = used[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(used, done + most, "right")))
            out[order, start:stop] = self._lanes([others[i] for i in order], index[start:stop])
            start = stop
        return out

    def _lanes(self, others: list[str], index: np.ndarray) -> np.ndarray:
        """``others``: longest first."""
        words = self.words[index]
        first = np.cumsum(words) - words
        mine = np.arange(words.sum()) - np.repeat(first - self.starts[index], words)
        codes = [np.frombuffer(other.encode("utf-32-le"), np.uint32) for other in others]
        alphabet = np.unique(np.concatenate(codes))
        places = np.stack([self._places(int(c))[mine] for c in alphabet]) if len(alphabet) else None
        lengths = np.array([len(c) for c in codes])
        steps = np.zeros((max(1, lengths[0]), len(codes)), np.int64)
        for i, row in enumerate(codes):
            steps[: len(row), i] = np.searchsorted(alphabet, row)
        inside, size = self.inside[mine], len(mine)
        begin = np.zeros(size, np.uint64)
        begin[first] = 1
        one, top = np.uint64(1), np.uint64(_WORD)
        up = np.tile(inside, len(codes))  # where a column grows downwards, and where it falls
        down = np.zeros_like(up)
        begins, insides = np.tile(begin, len(codes)), up.copy()
        spare = [np.empty_like(up) for _ in range(5)]
        either, both, add, not_, left, right = (
            np.bitwise_or, np.bitwise_and, np.add, np.invert, np.left_shift, np.right_shift
        )
        start = 0
        for live in range(len(codes), 0, -1):  # others with a character left
            n = live * size
            pv, mv, first_bits, inner = up[:n], down[:n], begins[:n], insides[:n]
            x, d, t, carry, more = (s[:n] for s in spare)
            x_next, d_next, t_next, carried = x[1:], d[1:], t[1:], carry[:-1]
            for at in range(start, lengths[live - 1]):
                here = places[steps[at, 0]] if live == 1 else places[steps[at, :live]].reshape(-1)
                either(here, mv, x)
                both(x, pv, d)
                add(d, pv, d)
                right(d, top, carry)
                add(d_next, carried, d_next)
                right(d, top, more)
                while np.count_nonzero(more) != np.count_nonzero(carry):  # it seldom passes a whole word
                    np.bitwise_xor(more, carry, carry)
                    add(d_next, carried, d_next)
                    carry[:] = more
                    right(d, top, more)
                np.bitwise_xor(d, pv, d)
                either(d, x, d)
                either(pv, d, t)
                not_(t, t)
                either(t, mv, t)
                both(pv, d, x)
                left(t, one, t)
                right(t, top, carry)
                either(t_next, carried, t_next)
                either(t, first_bits, t)
                left(x, one, x)
                right(x, top, carry)
                either(x_next, carried, x_next)
                both(d, t, mv)
                either(d, t, pv)
                not_(pv, pv)
                either(pv, x, pv)
                both(pv, inner, pv)
            start = lengths[live - 1]
        np.bitwise_and(down, np.tile(inside, len(codes)), out=down)
        grown = np.bitwise_count(up).astype(np.int64) - np.bitwise_count(down)
        return lengths[:, None] + np.add.reduceat(grown.reshape(len(codes), size), first, axis=1)


_BAND_WORDS = 16_384     # words near the diagonal worked on at once
_FEW_WORDS = 48          # fewer of them are compared one text at a time


class IndelTexts:
    """Texts as words of bits, of which those within reach of an Indel ratio with another text are found many
    at a time: a few numpy steps per character of the other text (Hyyro 2004). A text leaves as soon as
    the ratio is out of its reach."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.words = self.lengths // _WORD + 1  # at least one spare bit, so that no carry leaves a text
        self.starts = np.cumsum(self.words) - self.words
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        own = np.repeat(np.arange(len(texts)), self.lengths)
        at = np.arange(len(codes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        word, bit = self.starts[own] + at // _WORD, np.uint64(1) << (at % _WORD).astype(np.uint64)
        self.by_code = np.argsort(codes, kind="stable")
        self.sorted_codes, self.word, self.bit = codes[self.by_code], word[self.by_code], bit[self.by_code]
        self.total = int(self.words.sum())
        self.inside = np.zeros(self.total + 1, np.uint64)  # and an empty word
        np.bitwise_or.at(self.inside, word, bit)
        self.places: dict[int, np.ndarray] = {}
        letters = np.bincount(own * _LETTERS + codes % _LETTERS, minlength=len(texts) * _LETTERS)
        self.letters = letters.reshape(len(texts), _LETTERS).astype(np.int32)

    def _places(self, code: int) -> np.ndarray:
        found = self.places.get(code)
        if found is None:
            if len(self.places) * self.total > _PLACES_WORDS:
                self.places.clear()
            found = np.zeros(self.total + 1, np.uint64)
            here = slice(*np.searchsorted(self.sorted_codes, [code, code + 1]))
            np.bitwise_or.at(found, self.word[here], self.bit[here])
            self.places[code] = found
        return found

    def reaches(self, other: str, index: np.ndarray, threshold: float) -> np.ndarray:
        """Which of ``index`` have an Indel ratio of at least ``threshold`` with ``other``."""
        codes = np.frombuffer(other.encode("utf-32-le"), np.uint32)
        total = self.lengths[index] + len(codes)
        # the score's own rounding decides at the limit, so what is needed is taken a little lower
        least = threshold * total / 200.0 - 1e-6
        index = index[np.minimum(self.lengths[index], len(codes)) >= least]
        if len(index):
            letters = np.bincount(codes % _LETTERS, minlength=_LETTERS).astype(np.int32)
            shared = np.minimum(self.letters[index], letters).sum(axis=1)
            index = index[shared >= threshold * (self.lengths[index] + len(codes)) / 200.0 - 1e-6]
        if not len(index):
            return index
        # an alignment that loses no more than it may stays near the diagonal
        spare = self.lengths[index] + len(codes) - 2.0 * (threshold * (self.lengths[index] + len(codes)) / 200.0 - 1e-6)
        used = np.cumsum(np.minimum(self.words[index], (spare + _STEP) // _WORD + 2) + 1)
        if used[-1] >= _FEW_WORDS:
            found, start = [], 0
            while start < len(index):
                stop = max(start + 1, int(np.searchsorted(used, (used[start - 1] if start else 0) + _BAND_WORDS, "right")))
                found.append(self._within_reach(codes, index[start:stop], threshold))
                start = stop
            index = np.concatenate(found)
        return index[indel_reaches([self.texts[i] for i in index], other, threshold)]

    def _within_reach(self, codes: np.ndarray, index: np.ndarray, threshold: float) -> np.ndarray:
        """Those that may reach the threshold. A carry that would pass a whole word is left out: the front of the
        text up to that word counts one more then, so no text is lost."""
        n, words = len(codes), self.words[index]
        first = np.cumsum(words) - words
        within = np.arange(words.sum()) - np.repeat(first, words)
        row = np.append(self.inside[within + np.repeat(self.starts[index], words)], np.uint64(0))
        lengths = self.lengths[index]
        least = threshold * (lengths + n) / 200.0 - 1e-6
        top = np.uint64(_WORD)
        for start in range(0, n, _STEP):
            stop = min(start + _STEP, n)
            # the words near the diagonal, and after each text's an empty one that takes a carry
            low = np.clip(np.floor(start - n + least).astype(np.int64) // _WORD, 0, words - 1)
            high = np.clip(np.ceil(stop + lengths - least).astype(np.int64) // _WORD, 0, words - 1)
            size = high - low + 2
            ends = np.cumsum(size)
            shift = np.arange(ends[-1]) + np.repeat(low - ends + size, size)
            of_row, of_text = shift + np.repeat(first, size), shift + np.repeat(self.starts[index], size)
            of_row[ends - 1], of_text[ends - 1] = len(row) - 1, self.total
            here, inside = row[of_row], self.inside[of_text]
            alphabet, steps = np.unique(codes[start:stop], return_inverse=True)
            places = [self._places(int(c))[of_text] for c in alphabet]
            hit, added, carry = (np.empty_like(here) for _ in range(3))
            added_next, carried = added[1:], carry[:-1]
            for step in steps.tolist():
                np.bitwise_and(here, places[step], hit)
                np.add(here, hit, added)
                np.bitwise_xor(here, hit, here)
                np.right_shift(added, top, carry)
                np.add(added_next, carried, added_next)
                np.bitwise_or(here, added, here)
                np.bitwise_and(here, inside, here)
            row[of_row] = here
            # what the fronts have in common, and at most all the rest: a front of the text that leaves as much
            # as the other has left gives the largest sum, as one character more or less changes either by one at most
            front = np.clip(lengths - n + stop, 0, lengths)
            bits = np.clip(np.repeat(front, words) - within * _WORD, 0, _WORD).astype(np.uint64)
            seen = ~row[:-1] & ((np.uint64(1) << bits) - np.uint64(1))
            common = np.add.reduceat(np.bitwise_count(seen).astype(np.int64), first)
            keep = common + np.minimum(lengths - front, n - stop) >= least
            if not keep.any():
                return index[:0]
            if not keep.all():
                kept = np.repeat(keep, words)
                row, within = np.append(row[:-1][kept], np.uint64(0)), within[kept]
                index, words, lengths, least, size = (x[keep] for x in (index, words, lengths, least, size))
                first = np.cumsum(words) - words
                if size.sum() < _FEW_WORDS:
                    break
        return index


def levenshtein_ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 * (1 - edits / length of the longer text); two empty strings score 100."""
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(a, b)), np.int64, len(a))
    edits = np.array([EditTexts([x]).distances([y], np.arange(1))[0, 0] for x, y in zip(a, b)], np.int64)
    return np.where(longest == 0, 100.0, 100.0 * (longest - edits) / np.maximum(longest, 1))


# --- Jaro-Winkler (UTF-8 bytes) ---------------------------------------------------------------

def _byte_rows(strings: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the column, where each string starts, and how long it is. No Python strings."""
    strings = strings.cast(pa.large_string())
    starts = np.frombuffer(strings.buffers()[1], np.int64)[
        strings.offset:strings.offset + len(strings) + 1
    ]
    data = strings.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, starts[:-1], np.diff(starts)


# Bytes that never occur in UTF-8, so padding equals nothing.
_PAD_LEFT, _PAD_RIGHT = 0xFF, 0xFE


def _matrix(flat, starts, lengths, pad: int) -> np.ndarray:
    width = max(1, int(lengths.max(initial=0)))
    column = np.arange(width)
    inside = column < lengths[:, None]
    out = np.full((len(starts), width), pad, np.uint8)
    out[inside] = flat[(starts[:, None] + column)[inside]]
    return out


def _low_bits(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.uint64)
    full = ~np.uint64(0)
    return np.where(n >= 64, full, (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))


def _flags(bits: np.ndarray, width: int) -> np.ndarray:
    as_bytes = bits.astype("<u8").view(np.uint8).reshape(len(bits), 8)
    return np.unpackbits(as_bytes, axis=1, count=width, bitorder="little").view(bool)


def _match_short(left, la, right, lb) -> tuple[np.ndarray, np.ndarray]:
    """Matched positions of texts up to 64 bytes, one word of flags per text."""
    n, one = len(left), np.uint64(1)
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    free = _low_bits(lb)
    all_right = free.copy()
    hit_left = np.zeros(n, np.uint64)
    bits = np.zeros((n, 8), np.uint8)
    used = (right.shape[1] + 7) // 8
    for i in range(left.shape[1]):
        low = np.maximum(i - window, 0)
        reach = _low_bits(np.minimum(i + window + 1, 64) - low) << low.astype(np.uint64)
        bits[:, :used] = np.packbits(right == left[:, i, None], axis=1, bitorder="little")
        candidate = bits.view("<u8")[:, 0] & free & reach
        first = candidate & (~candidate + one)
        free ^= first
        hit_left |= (first != 0).astype(np.uint64) << np.uint64(i)
    return _flags(hit_left, left.shape[1]), _flags(all_right & ~free, right.shape[1])


def _match_long(left, la, right, lb) -> tuple[np.ndarray, np.ndarray]:
    window = np.maximum(np.maximum(la, lb) // 2 - 1, 0)[:, None]
    column = np.arange(right.shape[1])
    free = column < lb[:, None]
    hit_left = np.zeros(left.shape, bool)
    hit_right = np.zeros(right.shape, bool)
    for i in range(left.shape[1]):
        candidate = (right == left[:, i, None]) & free & (np.abs(column - i) <= window)
        first = candidate.argmax(axis=1)
        rows = np.flatnonzero(candidate[np.arange(len(first)), first])
        hit_left[rows, i] = True
        hit_right[rows, first[rows]] = True
        free[rows, first[rows]] = False
    return hit_left, hit_right


def _matched(chars: np.ndarray, flags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Matched characters moved to the left, in order."""
    width = max(1, int(counts.max(initial=0)))
    out = np.zeros((len(chars), width), np.uint8)
    out[np.arange(width) < counts[:, None]] = chars[flags]
    return out


def _jaro_winkler_slice(left, la, right, lb) -> np.ndarray:
    short = max(left.shape[1], right.shape[1]) <= 64
    hit_left, hit_right = (_match_short if short else _match_long)(left, la, right, lb)
    m = hit_left.sum(axis=1)
    moved = (_matched(left, hit_left, m) != _matched(right, hit_right, m)).sum(axis=1) // 2
    some = np.maximum(m, 1)
    jaro = np.where(
        m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - moved) / some) / 3.0, 0.0
    )
    head = min(4, left.shape[1], right.shape[1])
    prefix = np.cumprod(left[:, :head] == right[:, :head], axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)


def jaro_winklers(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Jaro-Winkler similarity of two null-free string arrays: prefix weight 0.1, at most 4
    characters, only above a Jaro of 0.7."""
    flat_a, start_a, len_a = _byte_rows(a)
    flat_b, start_b, len_b = _byte_rows(b)
    out = np.zeros(len(a))
    for part in _chunks(np.maximum(np.maximum(len_a, len_b), 8)):
        la, lb = len_a[part], len_b[part]
        out[part] = _jaro_winkler_slice(
            _matrix(flat_a, start_a[part], la, _PAD_LEFT), la,
            _matrix(flat_b, start_b[part], lb, _PAD_RIGHT), lb,
        )
    return out
