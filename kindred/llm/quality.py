"""Quality rules as weak supervision.

Each rule looks at one property of a text and votes good (1), bad (-1) or abstains (0). How far a
rule can be trusted is not set by hand: expectation-maximisation finds, from the votes of all
documents, the share of good documents and for each rule how often it says what for good and for
bad ones. A document's posterior probability of being good decides: a rule whose votes against
spread over all documents alike is outvoted by the others, several weak signs reject a text, and
one sign alone does where the votes show it to be a kind of defect of its own.

Spark counts the vote patterns of all documents; there are at most 3 ** (number of rules) of them,
whatever the table holds, and EM runs on those counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.common import as_bytes, col, written

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
_NOT_MARKS = bytes(b for b in range(256) if b not in b"!?")
_NOT_DIGITS = bytes(b for b in range(256) if b not in b"0123456789")
_CONTINUES = bytes(range(0x80, 0xC0))  # bytes that go on with a UTF-8 character
_UPPER = bytes(range(65, 91))
_NOT_LETTERS = bytes(b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122))
_NOT_UPPER = bytes(b for b in range(256) if b not in _UPPER)

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_distinct long, n_upper long, n_letters long, n_marks long, n_lines long"
)


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of STATS for one whole text; all 0 for null and empty texts."""
    data = as_bytes(text)
    words = data.split()
    n = len(words)
    lines = data.split(b"\n")
    seen: set[bytes] = set()
    dup = filled = 0
    for line in lines:
        if line.strip():
            filled += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    letters = data.translate(None, _NOT_LETTERS)
    joined = len(data) - len(data.translate(None, b" \t\n\v\f\r"))
    chars = len(data) - joined - (len(data) - len(data.translate(None, _CONTINUES)))
    return (
        n, chars, len(data.translate(None, _NOT_SYMBOLS)), dup, repeated_words(ids, len(index)), len(index),
        len(letters.translate(None, _NOT_UPPER)), len(letters), len(data.translate(None, _NOT_MARKS)), filled,
    )


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in a 3-word window which occurs twice or more, its first occurrence included."""
    n = len(ids)
    if n < 4 or distinct == n:
        return 0
    if distinct < 2_000_000:
        windows = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:  # the product would not fit; number the pairs first
        _, pairs = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)
        windows = pairs * distinct + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def stats_column(text: Column) -> Column:
    """STATS of a text column as a struct."""

    @F.pandas_udf(STATS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [p.split()[0] for p in STATS.split(", ")]
        for texts in batches:
            yield pd.DataFrame([text_stats(t) for t in texts], columns=names, dtype="int64")

    return run(text)


def rules(s: str = "s") -> dict[str, Column]:
    """The votes, from a struct column of STATS."""
    v = {p.split()[0]: F.col(f"{s}.{p.split()[0]}") for p in STATS.split(", ")}
    n = F.greatest(v["n_words"], F.lit(1))
    length = v["word_chars"] / n

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    return {
        "length": vote(v["n_words"] < 20, v["n_words"] >= 50),
        "word_length": vote((length < 2.5) | (length > 14), (length >= 3) & (length <= 10)),
        "symbols": vote(v["n_symbols"] > 0.2 * n, v["n_symbols"] <= 0.02 * n),
        "marks": vote(v["n_marks"] > 0.3 * n, v["n_marks"] <= 0.1 * n),
        "upper": vote(v["n_upper"] > 0.5 * v["n_letters"], v["n_upper"] <= 0.2 * v["n_letters"]),
        "lines": vote(v["n_dup_lines"] > 0.5 * v["n_lines"], v["n_dup_lines"] <= 0.3 * v["n_lines"]),
        "windows": vote(v["n_repeat_words"] > 0.4 * n, v["n_repeat_words"] <= 0.3 * n),
        "variety": vote((v["n_distinct"] < 0.2 * n) & (v["n_words"] < 2000), v["n_distinct"] > 0.4 * n),
    }

# pseudo-counts of Votes with kinds, as parts of all items: good items and those of each kind; a
# voter's false and other votes on items that are not of its kind; its votes on those that are
PRIOR = {"good": 0.02, "kind": 0.0005, "false": 0.001, "not_false": 0.02, "true": 0.285, "missed": 0.015}


class Votes:
    """Reliabilities of voters, by expectation-maximisation over counted vote patterns.

    Classes are good and one or several kinds of bad; ``chance[c, r, v]`` is the chance that voter r
    votes v - 1 on an item of class c, ``share[c]`` the share of the class.

    With ``kinds``, each voter has a kind of bad of its own, as bad items are bad for different reasons.
    A kind may be seen by several voters: its own and those who say bad of most of its items. All
    other votes against are false, and a voter's share of false votes is one for all classes: who is
    wrong at random is so on items with other defects as well, while a defect that comes alone keeps
    away from them. That tells a poor voter from a defect of its own. Nothing bounds either share;
    what the items don't tell is left to pseudo-counts, which are parts of the total (PRIOR), so
    tables of any size with the same shares are judged alike.

    With ``neutral``, voters who abstain say nothing about an item; else that they do is a sign too.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, kinds: bool = False, neutral: bool = False, rounds: int | None = None,
                 tolerance: float = 1e-9):
        self.neutral = neutral
        rounds = rounds or (5000 if kinds else 500)
        hot = self.indicators(patterns)
        voters = patterns.shape[1]
        against = (patterns < 0).astype(float)
        total = max(1.0, counts.sum())
        # start: one vote against makes an item bad, of the kinds of those who vote so
        bad = against if kinds else (against.sum(axis=1, keepdims=True) > 0).astype(float)
        some = bad.sum(axis=1, keepdims=True)
        bad = np.where(some > 0, bad / np.maximum(some, 1), 1 / bad.shape[1])
        good = np.where(some > 0, 0.5, 0.99) if kinds else np.where(some > 0, 0.1, 0.9)
        p = np.hstack([good, (1 - good) * bad])
        self.chance, self.share = np.zeros((p.shape[1], voters, 3)), np.zeros(p.shape[1])
        self.converged, self.rounds = False, 0
        for self.rounds in range(1, rounds + 1):
            w = p * counts[:, None]
            size = w.sum(axis=0)
            votes = np.einsum("pc,prv->crv", w, hot)
            if kinds:
                chance, share = self._learn(votes / total, size / total)
            else:
                # a part of an item more of each vote keeps every chance above zero
                chance = votes + 0.1
                chance /= chance.sum(axis=2, keepdims=True)
                share = (size + 0.1) / (total + 0.1 * len(size))
            moved = max(np.abs(chance - self.chance).max(), np.abs(share - self.share).max())
            self.chance, self.share = chance, share
            p = self.classes(hot)
            if moved < tolerance:
                self.converged = True
                break

    @staticmethod
    def _learn(votes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chances and shares of the classes, from their votes and sizes as parts of the total."""
        voters = votes.shape[1]
        against, size = votes[:, :, 0], size[:, None]
        own = np.eye(voters + 1, voters, -1) > 0
        sees = own | (against >= 0.5 * (size + 1e-5))
        sees[0] = False
        false = (np.where(sees, 0, against).sum(axis=0) + PRIOR["false"]) / (
            np.where(sees, 0, size).sum(axis=0) + PRIOR["false"] + PRIOR["not_false"]
        )
        true = (against + np.where(own, PRIOR["true"], 1e-6)) / (size + np.where(own, PRIOR["true"] + PRIOR["missed"], 2e-6))
        bad = np.where(sees, true, false)[:, :, None]
        rest = votes[:, :, 1:] + 1e-4 * votes[:, :, 1:].sum(axis=0) + 1e-7
        rest /= rest.sum(axis=2, keepdims=True)
        share = size[:, 0] + np.array([PRIOR["good"]] + [PRIOR["kind"]] * voters)
        return np.concatenate([bad, (1 - bad) * rest], axis=2), share / share.sum()

    def indicators(self, patterns: np.ndarray) -> np.ndarray:
        hot = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)
        if self.neutral:
            hot[:, :, 1] = 0.0
        return hot

    def classes(self, hot: np.ndarray) -> np.ndarray:
        """Posterior of every class, by pattern."""
        logs = np.log(self.share) + np.einsum("prv,crv->pc", hot, np.log(self.chance))
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being good."""
        return self.classes(self.indicators(patterns))[:, 0]

    def posterior_column(self, votes: list[Column]) -> Column:
        """The same from vote columns."""
        weights = []
        for share, chance in zip(self.share, np.log(self.chance)):
            log = F.lit(math.log(share))
            for vote, c in zip(votes, chance):
                log = log + F.when(vote < 0, float(c[0])).when(vote > 0, float(c[2])).otherwise(float(c[1]))
            weights.append(F.exp(log))
        return weights[0] / sum(weights[1:], weights[0])


def judge_quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (under 50
    words, or over half of them in repeated 3-word windows), quality (posterior probability of
    being good), kept (quality of at least ``least`` and not base_failed), per row of ``docs``.

    Null and empty texts have no words and fail. Repeated rows are judged each and count each. An
    empty table gives none. Whole texts are read; columns other than id and text are not.
    """
    stats = docs.select(col(id_col).alias("doc_id"), stats_column(col(text_col)).alias("s"))
    voted = written(stats.select("doc_id", "s", *(v.cast("int").alias(f"v_{name}") for name, v in rules().items())))
    names = [f"v_{name}" for name in rules()]
    failed = (F.col("s.n_words") < 50) | (100 * F.col("s.n_repeat_words") > 50 * F.col("s.n_words"))
    patterns = sorted(tuple(r) for r in voted.groupBy(*names).count().collect())  # at most 3 ** 8 rows
    if not patterns:
        patterns = [(0,) * len(names) + (0,)]
    table = np.array(patterns, dtype=np.int64)
    model = Votes(table[:, :-1], table[:, -1].astype(float), kinds=True)
    quality = model.posterior_column([F.col(c) for c in names])
    return voted.select(
        "doc_id", "s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words",
        failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= least)).alias("kept"),
    )
