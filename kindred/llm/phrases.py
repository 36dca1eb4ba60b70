"""Collocations: phrases of two and three words, counted by double-array tries.

1. Texts become blocks of word numbers, with a break wherever a phrase cannot go on. A block numbers
   its own words, so no vocabulary is sent to tasks; the words of all blocks are summed in Spark, the
   frequent ones get numbers of their own (by falling frequency), and blocks are renumbered by a join.
2. Candidates are Apriori-safe: a phrase can only be frequent if both its shorter parts are. Of two
   words, neighbours that are both frequent are summed per key over all blocks; of three words, those
   that start (and, as far as the same trie knows, end) with a frequent pair. Keys whose sum stays below
   the least count cannot be frequent and go.
3. The candidates of one round, at most ``trie_phrases``, become a double-array trie over the digits of
   word numbers, which is broadcast. numpy advances the states of all positions of a block at once, digit
   by digit; positions without a transition drop out. Accepting states are counted per block and summed.

What a task holds is bounded by ``block_words`` and ``trie_phrases``; a larger set of candidates
takes more rounds, each a pass over the numbered blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.taskcontext import TaskContext

from kindred.llm.common import col, written
from kindred.plans.ids import number_rows

_BREAK = -1
_NOTHING = -2
# A-Z to a-z, everything that ends a piece to a line break, tab to blank
_FOLD = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n\n "
)
_DIGIT_BITS = 11
_WINDOW = 4096


class _Numbers(dict):
    """Numbers words in the order they come; all languages of a block share the list of ``words``."""

    def __init__(self, words: list[bytes]):
        super().__init__({b"": _NOTHING, b"\n": _BREAK})
        self.words = words

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.words)
        self.words.append(word)
        return number


def _packed(codes: np.ndarray) -> bytes:
    return pa.compress(codes.astype("<i4").tobytes(), "zstd", asbytes=True)


def _unpacked(codes: bytes, length: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(codes, 4 * length, "zstd", asbytes=True), "<i4")


def _blocks(docs: DataFrame, block_words: int, lang_col: str, text_col: str) -> DataFrame:
    """Two kinds of rows: the numbered text of a block (codes, length), and its words (number, lang, word, n)."""
    names = ["block", "number", "lang", "word", "n", "codes", "length"]
    types = [pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.binary(), pa.int32()]

    def rows(**given) -> pa.RecordBatch:
        count = len(given["block"])
        return pa.RecordBatch.from_arrays(
            [pa.array(given[name], kind) if name in given else pa.nulls(count, kind) for name, kind in zip(names, types)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        words: list[bytes] = []
        langs: dict[str, _Numbers] = {}
        lang_of: list[str] = []
        codes: list[np.ndarray] = []
        held = 0

        def close() -> Iterator[pa.RecordBatch]:
            whole = np.concatenate(codes)
            counts = np.bincount(whole[whole >= 0], minlength=len(words))
            for start in range(0, len(words), 100_000):
                part = slice(start, start + 100_000)
                size = len(words[part])
                yield rows(
                    block=np.full(size, block), number=np.arange(start, start + size, dtype=np.int32),
                    lang=lang_of[part], word=words[part], n=counts[part],
                )
            yield rows(block=[block], codes=[_packed(whole)], length=[len(whole)])

        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), texts):
                tokens = text.as_py().translate(_FOLD).replace(b"\n", b" \n ").split(b" ")
                numbers = langs.get(lang)
                if numbers is None:
                    numbers = langs[lang] = _Numbers(words)
                found = np.fromiter(map(numbers.__getitem__, tokens), np.int32, len(tokens))
                lang_of += [lang] * (len(words) - len(lang_of))
                codes += (found[found != _NOTHING], np.array([_BREAK], np.int32))
                held += len(tokens)
                if held >= block_words:
                    yield from close()
                    block, held = block + 1, 0
                    words, langs, lang_of, codes = [], {}, [], []
        if codes:
            yield from close()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    texts = docs.select(F.coalesce(col(lang_col), F.lit("und")).alias("lang"), col(text_col).alias("text")).where("text <> ''")
    return texts.mapInArrow(run, "block long, number int, lang string, word binary, n long, codes binary, length int")


def _renumbered(blocks: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """codes, length: the blocks with the vocabulary's numbers; other words become breaks."""
    texts = blocks.where("codes is not null").select(F.col("block").alias("of"), "codes", "length")
    maps = blocks.where("word is not null").join(vocabulary, ["lang", "word"]).select("block", "number", "id")

    def run(known: pa.Table, text: pa.Table) -> pa.Table:
        out = []
        for codes, length in zip(text.column("codes").to_pylist(), text.column("length").to_pylist()):
            old = _unpacked(codes, length)
            table = np.full(int(old.max(initial=0)) + 2, _BREAK, np.int32)  # the last one is for breaks
            table[known.column("number").to_numpy()] = known.column("id").to_numpy()
            new = table[old]
            # of breaks side by side one is enough
            new = new[(new != _BREAK) | (np.append(_BREAK + 1, new[:-1]) != _BREAK)]
            out.append((_packed(new), len(new)))
        return pa.table({"codes": pa.array([c for c, _ in out], pa.binary()), "length": pa.array([n for _, n in out], pa.int32())})

    return maps.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(run, "codes binary, length int")


def _codes_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[np.ndarray]:
    """Numbered texts, several blocks together up to ``most`` numbers."""
    held: list[np.ndarray] = []
    for batch in batches:
        for codes, length in zip(batch.column("codes").to_pylist(), batch.column("length").to_pylist()):
            if held and sum(map(len, held)) + length > most:
                yield np.concatenate(held)
                held = []
            held += (_unpacked(codes, length), np.array([_BREAK], np.int32))
    if held:
        yield np.concatenate(held)
    pa.default_memory_pool().release_unused()


def _pieces(codes: np.ndarray, at_once: int) -> Iterator[np.ndarray]:
    """Parts of a numbered text, cut at breaks where there are any, so that no phrase is cut."""
    breaks = np.flatnonzero(codes == _BREAK)
    start = 0
    while start < len(codes):
        later = breaks[np.searchsorted(breaks, start + at_once) :]
        end = int(later[0]) + 1 if len(later) else len(codes)
        yield codes[start:end]
        start = end


def _rows(columns: dict[str, np.ndarray], at_once: int = 500_000) -> Iterator[pa.RecordBatch]:
    size = len(next(iter(columns.values())))
    for start in range(0, size, at_once):
        yield pa.RecordBatch.from_arrays([pa.array(v[start : start + at_once]) for v in columns.values()], list(columns))


def _summed(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Distinct keys and how often each occurs (n); sorts ``keys`` in place."""
    keys.sort()
    begin = np.flatnonzero(np.append(len(keys) > 0, keys[1:] != keys[:-1]))
    return {name: keys[begin], "n": np.diff(begin, append=len(keys))}


def _neighbours(coded: DataFrame, most: int) -> DataFrame:
    """pair (two numbers, 32 bits each), n: neighbours that are both frequent, summed per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _codes_of(batches, most):
            starts = np.flatnonzero((codes[:-1] >= 0) & (codes[1:] >= 0)).astype(np.int32)
            pairs = codes[starts].astype(np.int64)
            pairs <<= 32
            pairs |= codes[starts + 1]
            del starts
            yield from _rows(_summed("pair", pairs))

    return coded.mapInArrow(run, "pair long, n long")


@dataclass
class DoubleArray:
    """A trie over digit strings in two arrays: from state s digit d leads to t = base[s] + d if
    check[t] == s. State 0 is the root; where a phrase ends, base is the number of the phrase."""

    base: np.ndarray
    check: np.ndarray
    shifts: tuple[int, ...]
    mask: int
    count: int

    @classmethod
    def build(cls, words: np.ndarray, largest: int) -> DoubleArray:
        """``words``: one row per phrase, distinct and in lexicographic order, of numbers up to ``largest``."""
        digits_each = max(1, -(-int(largest).bit_length() // _DIGIT_BITS))
        bits = -(-max(1, int(largest).bit_length()) // digits_each)
        shifts = tuple(bits * i for i in range(digits_each - 1, -1, -1))
        mask = (1 << bits) - 1
        digits = np.stack([(words[:, w].astype(np.int64) >> s) & mask for w in range(words.shape[1]) for s in shifts], axis=1)
        # children of every level, in order, with their label and the number of their parent
        labels, parents, begins = [], [], []
        fresh = np.zeros(len(digits), bool)
        node = np.zeros(len(digits), np.int64)
        for level in range(digits.shape[1]):
            fresh[0] = True
            fresh[1:] |= digits[1:, level] != digits[:-1, level]
            labels.append(digits[fresh, level])
            parents.append(node[fresh])
            begins.append(np.searchsorted(parents[-1], np.arange(node[-1] + 1)))
            node = np.cumsum(fresh) - 1
        bases, size = _place(labels, begins, mask + 1)
        base, check = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        slot = np.zeros(1, np.int64)
        for level in range(len(labels)):
            base[slot] = bases[level]
            child = bases[level][parents[level]] + labels[level]
            check[child] = slot[parents[level]]
            slot = child
        base[slot] = np.arange(len(words), dtype=np.int32)
        return cls(base, check, shifts, mask, len(words))

    def matches(self, codes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions where a phrase of so many words starts, and its number."""
        at = np.arange(max(0, len(codes) - words + 1), dtype=np.int32)
        state = np.zeros(len(at), np.int32)
        for w in range(words):
            word = codes[at + w]
            on = word >= 0
            at, state, word = at[on], state[on], word[on]
            for shift in self.shifts:
                following = self.base[state] + ((word >> shift) & self.mask)
                on = self.check[following] == state
                at, state, word = at[on], following[on], word[on]
        return at, self.base[state]


def _place(labels: list[np.ndarray], begins: list[np.ndarray], width: int) -> tuple[list[np.ndarray], int]:
    """A base for every inner node so that no two children share a slot; nodes with many children
    first, those with one child fill the gaps."""
    bases = [np.zeros(len(b), np.int64) for b in begins]
    ends = [np.append(b[1:], len(lab)) for b, lab in zip(begins, labels)]
    sizes = [e - b for b, e in zip(begins, ends)]
    level = np.repeat(np.arange(len(begins)), [len(b) for b in begins])
    which = np.concatenate([np.arange(len(b)) for b in begins])
    many = np.concatenate(sizes)
    order = np.argsort(-many, kind="stable")
    # slots below ``width`` stay empty, so that a base is never below zero
    used = np.zeros(2 * width + int(many.sum()) * 2 + _WINDOW, bool)
    used[:width] = True
    frontier, kind = width, 0
    for i in order[: int((many > 1).sum())].tolist():
        lev, node = level[i], which[i]
        mine = labels[lev][begins[lev][node] : ends[lev][node]]
        first, k = int(mine[0]), len(mine)
        rel = (mine - first).tolist()
        if k <= 16 and k != kind:  # small families look for gaps from the start, one scan per size
            frontier = width
        kind = k
        while True:
            if frontier + _WINDOW + width >= len(used):
                used = np.append(used, np.zeros(len(used), bool))
            free = ~used[frontier : frontier + _WINDOW]
            for r in rel[1:]:
                free &= ~used[frontier + r : frontier + r + _WINDOW]
            at = int(free.argmax())
            if free[at]:
                break
            frontier += _WINDOW
        used[frontier + at + mine - first] = True
        bases[lev][node] = frontier + at - first
    single = order[int((many > 1).sum()) :]
    gaps = np.flatnonzero(~used)
    if len(gaps) < len(single):
        gaps = np.append(gaps, np.arange(len(used), len(used) + len(single)))
    gaps = gaps[: len(single)]
    for lev in range(len(begins)):
        mine = level[single] == lev
        nodes = which[single][mine]
        bases[lev][nodes] = gaps[mine] - labels[lev][begins[lev][nodes]]
    top = max((int((b + np.maximum.reduceat(lab, beg)).max()) for b, lab, beg in zip(bases, labels, begins)), default=0)
    # any digit from any base must stay inside
    return bases, top + 2 * width


def _rounds(candidates: DataFrame, keys: list[str], trie_phrases: int) -> Iterator[np.ndarray]:
    """The candidates, at most about ``trie_phrases`` at a time, as sorted rows."""
    count = candidates.count()
    rounds = max(1, -(-count // trie_phrases))
    for r in range(rounds if count else 0):
        part = candidates.where(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == r).select(*keys).toArrow()
        rows = np.stack([part.column(k).to_numpy() for k in keys], axis=1)
        yield rows[np.lexsort(rows.T[::-1])]


def _each_round(spark, coded: DataFrame, candidates: DataFrame, keys: list[str], largest: int, trie_phrases: int,
                run: Callable, schema: str, split: Callable[[np.ndarray], np.ndarray]) -> DataFrame | None:
    """``run(batches, trie, rows)`` over all blocks for the trie of every round; written, then united."""
    out = None
    for rows in _rounds(candidates, keys, trie_phrases):
        # arrays only: tasks need no installed copy of the class
        sent = spark.sparkContext.broadcast((tuple(vars(DoubleArray.build(split(rows), largest)).values()), rows))

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            fields, rows = sent.value
            return run(batches, DoubleArray(*fields), rows)

        made = written(coded.mapInArrow(task, schema))
        sent.destroy()
        out = made if out is None else out.unionByName(made)
    return out


def _words_of_pair(rows: np.ndarray) -> np.ndarray:
    return np.stack([rows[:, 0] >> 32, rows[:, 0] & 0xFFFFFFFF], axis=1)


def phrase_counts(docs: DataFrame, least: int = 10, block_words: int = 1_000_000, trie_phrases: int = 1_000_000,
                  lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Four written tables: words (id, lang, word, f), pairs (pair, f) and triples (pair, third, f) that
    occur at least ``least`` times, and totals (lang, n: all words of a language).

    A pair is id * 2^32 + id; every language has ids of its own.
    """
    spark = docs.sparkSession
    blocks = written(_blocks(docs, block_words, lang_col, text_col))
    own = blocks.where("word is not null").select("lang", "word", "n")
    totals = written(own.groupBy("lang").agg(F.sum("n").alias("n")))
    frequent = own.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = written(number_rows(frequent, [F.desc("f"), F.col("lang"), F.col("word")], "id"))
    largest = words.count()
    if largest >= 1 << 31:
        raise ValueError("More than 2^31 frequent words.")
    coded = written(_renumbered(blocks, words.select("lang", "word", "id")))
    # a fraction of a block's own arrays at a time
    most, at_once = block_words, max(1, block_words // 4)

    near = written(_neighbours(coded, most).groupBy("pair").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("pair"))

    def pairs_run(batches: Iterator[pa.RecordBatch], trie: DoubleArray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Counts of pairs (third -1), and sums of the triples that may be frequent."""
        counts = np.zeros(trie.count, np.int64)
        for whole in _codes_of(batches, most):
            triples = []
            for codes in _pieces(whole, at_once):
                at, number = trie.matches(codes, 2)
                counts += np.bincount(number, minlength=trie.count)
                starts = np.zeros(len(codes) + 1, bool)
                starts[at] = True
                inside = at + 2 < len(codes)
                at, number = at[inside], number[inside]
                following = codes[at + 2]
                on = following >= 0
                if trie.count == total:  # this trie knows all pairs: the second one must be there as well
                    on &= starts[at + 1]
                triples.append((number[on].astype(np.int64) << 32) | following[on])
            found = _summed("key", np.concatenate(triples))
            yield from _rows({
                "pair": rows[found["key"] >> 32, 0], "third": (found["key"] & 0xFFFFFFFF).astype(np.int32), "n": found["n"]
            })
        seen = np.flatnonzero(counts)
        yield from _rows({"pair": rows[seen, 0], "third": np.full(len(seen), -1, np.int32), "n": counts[seen]})

    total = near.count()
    summed = _each_round(spark, coded, near, ["pair"], largest, trie_phrases, pairs_run, "pair long, third int, n long", _words_of_pair)
    if summed is None:
        summed = spark.createDataFrame([], "pair long, third int, n long")
    summed = written(summed.groupBy("pair", "third").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    pairs = summed.where("third = -1").select("pair", "f")

    def triples_run(batches: Iterator[pa.RecordBatch], trie: DoubleArray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(trie.count, np.int64)
        for whole in _codes_of(batches, most):
            for codes in _pieces(whole, at_once):
                counts += np.bincount(trie.matches(codes, 3)[1], minlength=trie.count)
        seen = np.flatnonzero(counts)
        yield from _rows({"pair": rows[seen, 0], "third": rows[seen, 1].astype(np.int32), "n": counts[seen]})

    chained = _each_round(
        spark, coded, summed.where("third >= 0").select("pair", F.col("third").cast("long").alias("third")), ["pair", "third"], largest,
        trie_phrases, triples_run, "pair long, third int, n long", lambda rows: np.column_stack([_words_of_pair(rows), rows[:, 1]]),
    )
    if chained is None:
        chained = spark.createDataFrame([], "pair long, third int, n long")
    triples = written(chained.groupBy("pair", "third").agg(F.sum("n").alias("f")).where(F.col("f") >= least))
    return words, pairs, triples, totals


def _score(a: str, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) in whole numbers of up to 38 digits."""
    wide = F.col(a).cast("decimal(16,0)")
    over = (wide * wide).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    under = left.cast("decimal(19,0)") * right.cast("decimal(19,0)")
    parts = F.struct(over.cast("decimal(38,0)").alias("over"), under.cast("decimal(38,0)").alias("under"))
    return F.call_function("div", parts["over"], parts["under"]).cast("long")


def collocations(docs: DataFrame, least: int = 10, top: int = 2000, inside_percent: int = 50, block_words: int = 1_000_000,
                 trie_phrases: int = 1_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """The ``top`` phrases of two and three words of every language: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut into pieces at . , ; : ! ? and line breaks, and pieces into words
    at blanks and tabs. a is the number of occurrences of the phrase within pieces, overlaps included, and
    at least ``least``. Cut after its first word (or, of three, its second) it has parts that occur l and r
    times, and floor(10^6 a^2 / (l r)) is the cut's score; the lowest counts, ties go to the first cut. n is the
    number of words in the language. Phrases that lie in a longer phrase which occurs at least
    ``inside_percent`` % as often are left out. Order: score and a falling, then the phrase by its bytes.

    A null language is ``und``, together with texts that say so. Null and empty texts have no words; repeated
    rows count as often as they occur; an empty table gives none. Ids and other columns are not read.
    Counts are whole numbers throughout; a may reach 3 * 10^15.
    """
    words, pairs, triples, totals = phrase_counts(docs, least, block_words, trie_phrases, lang_col, text_col)
    first, second = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))

    def known(side: str) -> DataFrame:
        return words.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(f"word_{side}"), F.col("f").alias(f"f_{side}"), F.col("lang").alias(f"lang_{side}"))

    def inside(one: DataFrame) -> DataFrame:
        return one.select("pair", F.col("f").alias("longer"))

    # the most frequent longer phrase around each pair
    second_pair = F.shiftleft(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)), 32).bitwiseOR(F.col("third").cast("long"))
    around = inside(triples).unionByName(inside(triples.withColumn("pair", second_pair))).groupBy("pair").agg(F.max("longer").alias("longer"))
    two = (
        pairs.join(around, "pair", "left").where(F.coalesce(F.col("longer") * 100 < F.col("f") * inside_percent, F.lit(True)))
        .select(F.col("f").alias("a"), first.alias("id_1"), second.alias("id_2"))
        .join(known("1"), "id_1").join(known("2"), "id_2")
        .select(
            F.col("lang_1").alias("lang"), F.concat_ws(" ", F.col("word_1").cast("string"), F.col("word_2").cast("string")).alias("phrase"),
            "a", F.col("f_1").alias("l"), F.col("f_2").alias("r"), _score("a", F.col("f_1"), F.col("f_2")).alias("score"),
        )
    )
    three = (
        triples.select(F.col("f").alias("a"), "pair", second_pair.alias("pair_2"), first.alias("id_1"), second.alias("id_2"), F.col("third").cast("long").alias("id_3"))
        .join(pairs.withColumnRenamed("f", "f_12"), "pair")
        .join(pairs.select(F.col("pair").alias("pair_2"), F.col("f").alias("f_23")), "pair_2")
        .join(known("1"), "id_1").join(known("2"), "id_2").join(known("3"), "id_3")
        .withColumn("early", _score("a", F.col("f_1"), F.col("f_23"))).withColumn("late", _score("a", F.col("f_12"), F.col("f_3")))
        .select(
            F.col("lang_1").alias("lang"),
            F.concat_ws(" ", F.col("word_1").cast("string"), F.col("word_2").cast("string"), F.col("word_3").cast("string")).alias("phrase"), "a",
            F.when(F.col("late") < F.col("early"), F.col("f_12")).otherwise(F.col("f_1")).alias("l"),
            F.when(F.col("late") < F.col("early"), F.col("f_3")).otherwise(F.col("f_23")).alias("r"),
            F.least("early", "late").alias("score"),
        )
    )
    # the rank limit works before the shuffle, so a language sends at most ``top`` rows per task
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.unionByName(three).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
