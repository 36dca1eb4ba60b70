"""Comparison levels of one value against many at once, for groups that make very many pairs.

``compare.level`` takes pairs, one row each, and pays for every pair that a join hands over. Here the
texts of one side are laid out once, a word of bits per text and character, and each text of the other
side passes over all of them: a few machine instructions per character and pair. The levels are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from kindred.functions.compare import EMAIL_LEVEL, NAME_LEVELS, top_level
from kindred.functions.distance import jaro_winklers

# Types with a kernel below; dates are left to the built-in expressions.
GRID_TYPES = ("exact", "name", "email", "phone")
_SHORT = 64  # bytes; longer texts go pair by pair
_PAIRS = 8_192  # single pairs compared at once


def _word(bits: int):
    return np.uint16 if bits <= 16 else np.uint32 if bits <= 32 else np.uint64


def _ones(n: np.ndarray) -> np.ndarray:
    """Words with the lowest n bits set."""
    n = n.astype(np.uint64)
    return np.where(n >= 64, ~np.uint64(0), (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))


class Texts:
    """The many: UTF-8 texts, as a matrix of bytes and as bits per byte value."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        raw = [t.encode() for t in texts]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.long = np.flatnonzero(size > _SHORT)
        short = [b"" if len(t) > _SHORT else t for t in raw]
        self.lengths = np.where(size > _SHORT, 0, size)
        self.width = max(1, int(self.lengths.max(initial=0)))
        # a byte that never occurs in UTF-8 fills the rows up
        self.matrix = np.frombuffer(b"".join(t.ljust(self.width, b"\xfe") for t in short), np.uint8).reshape(len(raw), self.width)
        self.columns = np.ascontiguousarray(self.matrix.T)
        self.word = _word(self.width)
        self.every = _ones(self.lengths).astype(self.word)
        self.where: dict[int, np.ndarray] = {}
        bits = np.zeros((len(raw), 8), np.uint8)
        used = (self.width + 7) // 8
        for byte in np.unique(self.matrix).tolist():
            if byte != 0xFE:
                bits[:, :used] = np.packbits(self.matrix == byte, axis=1, bitorder="little")
                self.where[byte] = bits.view("<u8")[:, 0].astype(self.word)
        self._windows: dict[int, list[np.ndarray]] = {}
        self._table: tuple[np.ndarray, np.ndarray] | None = None

    def _reach(self, length: int) -> list[np.ndarray]:
        """Per position of a text of this length, the positions it may match in each of the many."""
        if length not in self._windows:
            window = np.maximum(np.maximum(length, self.lengths) // 2 - 1, 0)
            out = []
            for i in range(length):
                low = np.maximum(i - window, 0)
                out.append((_ones(np.minimum(i + window + 1, 64) - low) << low.astype(np.uint64)).astype(self.word))
            self._windows[length] = out
        return self._windows[length]

    def jaro_winkler(self, text: str, start: int) -> np.ndarray:
        """Similarity of ``text`` (first) with each of the many from ``start`` on (second)."""
        one = text.encode()
        if len(one) > _SHORT:
            rest = self.texts[start:]
            return jaro_winklers(pa.array([text] * len(rest), pa.string()), pa.array(rest, pa.string()))
        free = self.every[start:].copy()
        count, moved = np.zeros(len(free), np.uint8), np.zeros(len(free), np.uint8)
        reach, hits = self._reach(len(one)), []
        for i, byte in enumerate(one):
            places = self.where.get(byte)
            if places is None:
                continue
            first = places[start:] & free
            first &= reach[i][start:]
            first &= np.negative(first)
            free ^= first
            hit = first != 0
            count += hit
            hits.append((places[start:], hit))
        used = self.every[start:] ^ free
        for places, hit in hits:
            # the next matched character of the other text, where this one is matched
            lowest = used & np.negative(used)
            lowest &= np.negative(hit.astype(self.word))
            used ^= lowest
            lowest &= places
            moved += hit & (lowest == 0)
        m, lengths = count.astype(np.int64), self.lengths[start:]
        some = np.maximum(m, 1)
        jaro = np.where(m > 0, (m / max(len(one), 1) + m / np.maximum(lengths, 1) + (m - moved // 2) / some) / 3.0, 0.0)
        prefix, alike = np.zeros(len(m), np.int64), np.ones(len(m), bool)
        for byte, column in zip(one[:4], self.columns):
            alike &= column[start:] == byte
            prefix += alike
        out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)
        long = self.long[np.searchsorted(self.long, start):]
        if len(long):
            rest = [self.texts[i] for i in long]
            out[long - start] = jaro_winklers(pa.array([text] * len(rest), pa.string()), pa.array(rest, pa.string()))
        return out

    def jaro_winkler_pairs(self, left: "Texts", at_l: np.ndarray, at_r: np.ndarray) -> np.ndarray:
        """Similarity of texts of ``left`` (first) with some of the many (second), pair by pair."""
        out = np.empty(len(at_l))
        for start in range(0, len(at_l), _PAIRS):
            part = slice(start, start + _PAIRS)
            out[part] = self._pairs(left, at_l[part], at_r[part])
        long = np.flatnonzero(np.isin(at_l, left.long) | np.isin(at_r, self.long)) if len(left.long) + len(self.long) else ()
        if len(long):
            texts = ([left.texts[i] for i in at_l[long]], [self.texts[i] for i in at_r[long]])
            out[long] = jaro_winklers(*(pa.array(t, pa.string()) for t in texts))
        return out

    def _pairs(self, left: "Texts", at_l: np.ndarray, at_r: np.ndarray) -> np.ndarray:
        if self._table is None:
            rows = np.zeros(256, np.int64)
            rows[list(self.where)] = np.arange(1, len(self.where) + 1)
            self._table = rows, np.stack([np.zeros(len(self.texts), self.word), *self.where.values()])
        rows, table = self._table
        first_text = left.matrix[at_l]
        sizes_l, sizes_r = left.lengths[at_l], self.lengths[at_r]
        window = np.maximum(np.maximum(sizes_l, sizes_r) // 2 - 1, 0)
        wide, column = np.arange(_SHORT // 2), rows[first_text]
        free = self.every[at_r]
        count, moved = np.zeros(len(at_l), np.uint8), np.zeros(len(at_l), np.uint8)
        hits = []
        for i in range(int(sizes_l.max(initial=0))):
            places = table[column[:, i], at_r]
            low = np.maximum(i - wide, 0)
            reach = (_ones(np.minimum(i + wide + 1, 64) - low) << low.astype(np.uint64)).astype(self.word)
            first = places & free
            first &= reach[window]
            first &= np.negative(first)
            free ^= first
            hit = first != 0
            count += hit
            hits.append((places, hit))
        used = self.every[at_r] ^ free
        for places, hit in hits:
            lowest = used & np.negative(used)
            lowest &= np.negative(hit.astype(self.word))
            used ^= lowest
            lowest &= places
            moved += hit & (lowest == 0)
        m = count.astype(np.int64)
        some = np.maximum(m, 1)
        jaro = np.where(
            m > 0, (m / np.maximum(sizes_l, 1) + m / np.maximum(sizes_r, 1) + (m - moved // 2) / some) / 3.0, 0.0
        )
        prefix, alike = np.zeros(len(m), np.int64), np.ones(len(m), bool)
        for i in range(min(4, left.width, self.width)):
            alike &= (first_text[:, i] == self.matrix[at_r, i]) & (i < sizes_l)
            prefix += alike
        return np.where(jaro > 0.7, jaro + prefix * 0.1 * (1.0 - jaro), jaro)

    def edits(self, text: str, start: int) -> np.ndarray:
        """Levenshtein distance (Myers 1999) in bytes; 3 stands for 3 and more where a text is long."""
        one = text.encode()
        if len(one) > _SHORT:
            return np.array([_few_edits(one, t.encode()) for t in self.texts[start:]], np.int64)
        lengths = self.lengths[start:]
        if one:
            word = _word(len(one))
            where = np.zeros(256, word)
            for i, byte in enumerate(one):
                where[byte] |= word(1 << i)
            last, unit = word(len(one) - 1), word(1)
            up, down = np.full(len(lengths), ~word(0)), np.zeros(len(lengths), word)
            out = np.full(len(lengths), len(one), np.int64)
            for j, column in enumerate(self.columns):
                same = where[column[start:]]
                diagonal = (((same & up) + up) ^ up) | same | down
                plus, minus = down | ~(diagonal | up), up & diagonal
                step = ((plus >> last) & unit).astype(np.int8) - ((minus >> last) & unit).astype(np.int8)
                out += step * (lengths > j)
                plus = (plus << unit) | unit
                up, down = (minus << unit) | ~(diagonal | plus), plus & diagonal
        else:
            out = lengths.copy()
        for i in self.long[np.searchsorted(self.long, start):].tolist():
            out[i - start] = _few_edits(one, self.texts[i].encode())
        return out


def _few_edits(a: bytes, b: bytes, most: int = 2) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    n = min(len(a), len(b))
    front = next((i for i in range(n) if a[i] != b[i]), n)
    back = next((i for i in range(n - front) if a[-1 - i] != b[-1 - i]), n - front)
    a, b = a[front : len(a) - back], b[front : len(b) - back]
    if not a or not b:
        return min(max(len(a), len(b)), most + 1)
    if not most:
        return 1
    return 1 + min(_few_edits(a[1:], b, most - 1), _few_edits(a, b[1:], most - 1), _few_edits(a[1:], b[1:], most - 1))


def codes(*sides: list) -> list[np.ndarray]:
    """Numbers that are equal where the values are; -1 where there is none."""
    known: dict = {}
    return [np.fromiter((-1 if v is None else known.setdefault(v, len(known)) for v in side), np.int64, len(side)) for side in sides]


class LevelRows:
    """Levels of each value of ``left`` against all of ``right``, a row at a time."""

    def __init__(self, kind: str, left: list, right: list):
        self.kind, self.top, self.left = kind, top_level(kind), left
        self.code_l, self.code_r = codes(left, right)
        self.unknown = self.code_r < 0
        self.right = right
        self._laid_out = False
        self.left_texts = None

    def _lay_out(self) -> None:
        if self.kind == "exact" or self._laid_out:
            return
        self._laid_out = True
        known = ["" if v is None else v for v in self.right]
        self.texts = Texts(known)
        if self.kind == "email":
            self.users = Texts([_user(v) for v in known])
            self.user_l, self.user_r = codes([_user(v or "") or None for v in self.left], [_user(v) or None for v in known])

    def _lay_out_left(self) -> None:
        self._lay_out()
        if self.left_texts is None:
            known = ["" if v is None else v for v in self.left]
            self.left_texts = Texts(known)
            self.left_users = Texts([_user(v) for v in known]) if self.kind == "email" else None

    def equal(self, i: int, start: int) -> np.ndarray:
        if self.code_l[i] < 0:
            return np.zeros(len(self.code_r) - start, bool)
        return self.code_r[start:] == self.code_l[i]

    def row(self, i: int, start: int) -> np.ndarray:
        """Levels of left value ``i`` with the right ones from ``start`` on."""
        if self.code_l[i] < 0:
            return np.full(len(self.code_r) - start, -1, np.int8)
        self._lay_out()
        text = self.left[i]
        if self.kind == "name":
            score = self.texts.jaro_winkler(text, start)
            out = np.zeros(len(score), np.int8)
            for limit in NAME_LEVELS:
                out += score >= limit
        elif self.kind == "email":
            out = (self.users.jaro_winkler(_user(text), start) >= EMAIL_LEVEL).astype(np.int8)
            out[self.texts.jaro_winkler(text, start) >= EMAIL_LEVEL] = 2
            if self.user_l[i] >= 0:
                out[self.user_r[start:] == self.user_l[i]] = 3
        elif self.kind == "phone":
            out = np.clip(3 - self.texts.edits(text, start), 0, 2).astype(np.int8)
        else:
            out = np.zeros(len(self.code_r) - start, np.int8)
        out[self.equal(i, start)] = self.top
        out[self.unknown[start:]] = -1
        return out

    def of_pairs(self, at_l: np.ndarray, at_r: np.ndarray) -> np.ndarray:
        """Levels of single pairs, for a slow type of which few pairs are asked for."""
        out = np.where(self.code_l[at_l] == self.code_r[at_r], self.top, 0).astype(np.int8)
        out[(self.code_l[at_l] < 0) | (self.code_r[at_r] < 0)] = -1
        open_ = out == 0
        if not open_.any():
            return out
        self._lay_out_left()
        if self.kind == "email":
            out[open_ & (self.user_l[at_l] >= 0) & (self.user_l[at_l] == self.user_r[at_r])] = 3
            open_ = out == 0
        l, r = at_l[open_], at_r[open_]
        score = self.texts.jaro_winkler_pairs(self.left_texts, l, r)
        if self.kind == "name":
            out[open_] = sum((score >= limit).astype(np.int8) for limit in NAME_LEVELS)
        else:
            by_user = self.users.jaro_winkler_pairs(self.left_users, l, r) >= EMAIL_LEVEL
            out[open_] = np.where(score >= EMAIL_LEVEL, 2, by_user)
        return out


def _user(address: str) -> str:
    return address.partition("@")[0]
