"""Toxicity by a weighted finite-state pattern grammar.

Words become tags (insult, threat verb, target, negation, reporting verb, ...). Five small weighted
transducers read the tags of a clause: insult, threat, target, negation and reported speech. They
are composed into one machine; each insult or finished threat it reads gives the word's weight
times what the other four make of it at that place. A clause's score is the sum; a text's score
follows from the sum over its clauses. So "you idiot" counts more than "idiot", and "he said you
are not an idiot" less.

Which words are insults, and how much they weigh, is learnt from labelled rows: whole words and
word beginnings (inflected languages) that occur in toxic texts far more often than in others.
The function words of the other four transducers are fixed lists in four languages.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from kindred.llm.common import col, written

# Function words of English, German, French and Spanish.
TARGETS = frozenset(
    "you your yours yourself u ye him her them they he she these those people everyone "
    "du dich dir dein deine ihr euch euer sie ihn ihnen leute "
    "tu toi te ton ta vous votre vos il elle eux gens "
    "tú ti tuyo usted ustedes vosotros vuestro él ella ellos gente".split()
)
NEGATIONS = frozenset(
    "not no never neither nor isn't aren't wasn't weren't don't doesn't didn't cannot can't won't without hardly "
    "nicht kein keine keinen niemals nie weder ohne pas jamais aucun aucune sans ni nunca jamás ningún ninguna sin tampoco".split()
)
REPORTS = frozenset(
    "said says say saying told tells called calls wrote writes claimed claims quoted quote reported reports according "
    "sagte sagt sagten nannte nennt schrieb behauptet zitiert laut dit disait appelle appelait écrit selon cite "
    "dijo dice decía llamó llama escribió según cita".split()
)
MODALS = frozenset(
    "will shall gonna should must going werde werden wird soll muss vais va vas allons doit voy vas vamos debe".split()
)
HARMS = frozenset(
    "kill murder shoot stab beat strangle hang lynch töten umbringen erschießen verprügeln erstechen tuer "
    "assassiner frapper égorger poignarder matar asesinar golpear apuñalar".split()
)
THREAT_WEIGHT = 3.0

WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
PIECES = re.compile(r"(?P<word>[^\W\d_]+(?:['’][^\W\d_]+)?)|(?P<end>[.!?;:\n]+)|(?P<quote>[\"“”«»„])")
PREFIXES = range(3, 10)

INSULT, HARM, TARGET, NEGATION, REPORT, MODAL, QUOTE, OTHER = range(8)


@dataclass(frozen=True)
class Transducer:
    """States are numbers from 0; ``steps[(state, tag)]`` is the next state (missing: ``rest``),
    ``factor[state]`` the weight given to what is emitted in that state."""

    steps: dict
    rest: dict
    factor: dict

    def step(self, state: int, tag: int) -> int:
        return self.steps.get((state, tag), self.rest[state])


def window(opener: int, length: int, weight: float) -> Transducer:
    """Weight ``weight`` for ``length`` words after ``opener``, else 1."""
    return Transducer(
        steps={(s, opener): length for s in range(length + 1)},
        rest={s: max(0, s - 1) for s in range(length + 1)},
        factor={s: weight if s else 1.0 for s in range(length + 1)},
    )


def reported(weight: float) -> Transducer:
    """After a reporting verb, or between quotation marks, to the end of the clause."""
    return Transducer(
        steps={(0, REPORT): 1, (0, QUOTE): 2, (2, QUOTE): 0, (1, QUOTE): 2},
        rest={0: 0, 1: 1, 2: 2}, factor={0: 1.0, 1: weight, 2: weight},
    )


def threat() -> Transducer:
    """A modal, within three words a verb of harm, within three words a target."""
    steps = {(s, MODAL): 3 for s in range(8)} | {(s, HARM): 6 for s in (1, 2, 3)} | {(s, TARGET): 7 for s in (4, 5, 6)}
    return Transducer(steps=steps, rest={0: 0, 1: 0, 2: 1, 3: 2, 4: 0, 5: 4, 6: 5, 7: 0}, factor={s: 1.0 for s in range(8)})


def insult() -> Transducer:
    """1 just after an insult was read."""
    return Transducer(steps={(s, INSULT): 1 for s in (0, 1)}, rest={0: 0, 1: 0}, factor={0: 1.0, 1: 1.0})


@dataclass
class Grammar:
    """The composition of the five transducers: product states reached from the start, made once."""

    negated: float = 0.3
    quoted: float = 0.5
    aimed: float = 1.5
    table: dict = field(default_factory=dict)

    def __post_init__(self):
        parts = (insult(), threat(), window(TARGET, 4, self.aimed), window(NEGATION, 3, self.negated), reported(self.quoted))
        names = {(0,) * len(parts): 0}
        todo = [(0,) * len(parts)]
        while todo:
            state = todo.pop()
            for tag in range(8):
                after = tuple(p.step(s, tag) for p, s in zip(parts, state))
                if after not in names:
                    names[after] = len(names)
                    todo.append(after)
                # the modifiers are taken as they stood before the word itself
                factor = math.prod(p.factor[s] for p, s in zip(parts[2:], state[2:]))
                emits = INSULT if after[0] == 1 else HARM if after[1] == 7 else None
                self.table[names[state], tag] = (names[after], emits, factor)

    def clause(self, tags: list[tuple[int, float]]) -> float:
        """Score of one clause given as (tag, weight of an insult)."""
        state, total = 0, 0.0
        for tag, weight in tags:
            state, emits, factor = self.table[state, tag]
            if emits == INSULT:
                total += weight * factor
            elif emits == HARM:
                total += THREAT_WEIGHT * factor
        return total


@dataclass
class Toxicity:
    """A trained scorer: insult lexicon (whole words end in $), grammar, calibration."""

    lexicon: dict[str, float]
    scale: tuple[float, float] = (-3.0, 3.0)
    grammar: Grammar = field(default_factory=Grammar)

    def __post_init__(self):
        self._known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """Weight as an insult, 0 if it is none."""
        found = self._known.get(word)
        if found is None:
            lexicon = self.lexicon
            found = max([lexicon.get(word + "$", 0.0), *(lexicon.get(word[:k], 0.0) for k in PREFIXES if k <= len(word))])
            if len(self._known) > 200_000:  # bounds memory only
                self._known.clear()
            self._known[word] = found
        return found

    def tag(self, word: str) -> tuple[int, float]:
        weight = self.weight(word)
        if weight:
            return INSULT, weight
        for tag, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (MODAL, MODALS), (HARM, HARMS)):
            if word in words:
                return tag, 0.0
        return OTHER, 0.0

    def evidence(self, text: str | None) -> float:
        """Sum of the clause scores of a text."""
        if not text:
            return 0.0
        text = text.lower()
        weight = self.weight
        # only clauses that hold an insult or a verb of harm can score
        if not any(weight(w) or w in HARMS for w in set(WORDS.findall(text))):
            return 0.0
        total, tags, live = 0.0, [], False
        for piece in PIECES.finditer(text):
            kind = piece.lastgroup
            if kind == "word":
                tag = self.tag(piece[0])
                live = live or tag[0] in (INSULT, HARM)
                tags.append(tag)
            elif kind == "quote":
                tags.append((QUOTE, 0.0))
            else:
                if live:
                    total += self.grammar.clause(tags)
                tags, live = [], False
        return total + (self.grammar.clause(tags) if live else 0.0)

    def score(self, evidence: float) -> float:
        a, b = self.scale
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(evidence)))))

    def column(self, text: Column) -> Column:
        """Score of a text column, 0 to 1."""
        model = self

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([model.score(model.evidence(t)) for t in texts], dtype="float64")

        return run(text)


def features(text: str | None) -> set[str]:
    """Whole words and word beginnings of a text, each once."""
    out = set()
    for word in set(WORDS.findall((text or "").lower())):
        out.add(word + "$")
        out.update(word[:k] for k in PREFIXES if k <= len(word))
    return out


def family_keys(text: str | None, keys: int = 4) -> list[int]:
    """Min-hashes of a text's 5-word shingles; near copies share one almost surely."""
    words = (text or "").lower().split()
    hashes = np.array([xxh64_intdigest(" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))], np.uint64)
    salts = np.random.default_rng(7).integers(1, 2**63, keys, dtype=np.uint64) | np.uint64(1)
    return [int((hashes * salt).min() >> np.uint64(1)) for salt in salts]


def one_per_family(rows: pd.DataFrame) -> list[int]:
    """Ids of rows (id, keys) of which no earlier row shares a key."""
    seen, kept = set(), []
    for doc_id, keys in zip(rows["id"].tolist(), rows["keys"]):
        own = {(i, k) for i, k in enumerate(keys)}
        if not own & seen:
            kept.append(doc_id)
        seen |= own
    return kept


def _gain(k: float, n: float, toxic: float, clean: float) -> float:
    """Log-likelihood ratio of a feature in k of ``toxic`` and n of ``clean`` texts."""
    rate, total = (k + n) / (toxic + clean), 0.0
    for seen, size in ((k, toxic), (n, clean)):
        for part, expected in ((seen, size * rate), (size - seen, size * (1 - rate))):
            if part > 0 and expected > 0:
                total += part * math.log(part / expected)
    return 2 * total


def choose_lexicon(counts: list[tuple[str, int, int]], toxic: int, clean: int, share: float = 0.95):
    """Insults and their weights from (feature, toxic texts, other texts).

    A feature must be significant, the more so the more are tried, and of its texts, at equal class sizes, at least ``share`` toxic.
    A word beginning gives way to a longer one, or to a whole word, that is as good: in nearly the
    same toxic texts, or in most of them and in fewer others.
    """
    gain = max(18.0, 6.0 + 2.0 * math.log(max(1, len(counts))))
    picked = {}
    for name, k, n in counts:
        rate_k, rate_n = k / max(1, toxic), (n + 0.5) / max(1, clean)
        if rate_k / (rate_k + rate_n) >= share and _gain(k, n, toxic, clean) >= gain:
            picked[name] = (k, n)
    beaten = set()
    for name, (k, n) in picked.items():
        for i in (i for i in PREFIXES if i < len(name)):
            if (shorter := picked.get(name[:i])) and name[:i] != name:
                if k >= 0.97 * shorter[0] or k >= 0.8 * shorter[0] and n < shorter[1]:
                    beaten.add(name[:i])
    chosen = {name for name in picked if name not in beaten}
    # what a chosen beginning covers needs no entry of its own
    chosen = {name for name in chosen if not any(name[:i] in chosen for i in PREFIXES if i < len(name))}
    weights = {m: math.log((picked[m][0] + 0.5) / (toxic + 1)) - math.log((picked[m][1] + 0.5) / (clean + 1)) for m in sorted(chosen)}
    top = max(weights.values(), default=1.0)
    return {name: weight / top for name, weight in weights.items()}


def labelled_texts(docs: DataFrame, labels: DataFrame, sample_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """id, y, text: at most ``sample_rows`` texts of each label, written. An id stands for one text however
    many rows have it: the one with the smallest hash."""
    known = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("y")).dropna().groupBy("id").agg(F.max("y").alias("y"))
    picked = [
        known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows) for y in (1, 0)
    ]
    sample = picked[0].unionByName(picked[1])  # at most 2 * sample_rows ids, small enough to broadcast
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(sample), "id")
    return written(texts.groupBy("id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text")))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> Toxicity:
    """Learn the insult lexicon and the calibration from labelled texts.

    ``labels``: id, label 0/1 (null: row is left out; an id with several labels counts as toxic if
    one is). At most ``sample_rows`` rows of each label are used, chosen by a hash of the id, so
    that the sample does not depend on how the tables are split, and one text of each id (see ``labelled_texts``). Without toxic rows the lexicon is
    empty and all scores are low. Of near copies within the sample one counts, or else any word of a
    text that was copied often would look like an insult.
    """
    rows = labelled_texts(docs, labels, sample_rows, id_col, text_col, label_col)

    def families(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "keys": [family_keys(t) for t in batch["text"]]})

    # a few numbers for each row of the bounded sample
    found = rows.mapInPandas(families, "id long, y int, keys array<long>").toPandas()
    if not len(found):
        return Toxicity({})
    kept = one_per_family(found.sort_values(["y", "id"], ascending=[False, True]))
    single = docs.sparkSession.createDataFrame([(i,) for i in kept], f"id {rows.schema['id'].dataType.simpleString()}")
    rows = rows.join(F.broadcast(single), "id")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(seen[0].keys() | seen[1].keys())
            return pd.DataFrame({"feature": pd.Series(names, dtype=object), "n": [seen[0][w] for w in names], "k": [seen[1][w] for w in names]})

        for batch in batches:
            for text, y in zip(batch["text"], batch["y"]):
                seen[int(y)].update(features(text))
                if len(seen[0]) + len(seen[1]) > 150_000:  # partial counts; Spark adds them up
                    yield out()
                    seen[0].clear(), seen[1].clear()
        yield out()

    sizes = dict(rows.groupBy("y").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return Toxicity({})
    # what can be significant at all is a few thousand features
    counts = (
        rows.mapInPandas(count, "feature string, n long, k long").groupBy("feature")
        .agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
        .where((F.col("k") >= 4) & (F.col("k") * max(1, clean) >= F.col("n") * 4 * toxic))
    )
    lexicon = choose_lexicon([tuple(r) for r in counts.collect()], toxic, clean)
    model = Toxicity(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "e": [model.evidence(t) for t in batch["text"]]})

    # two numbers of each row of the bounded sample
    points = rows.mapInPandas(measure, "y int, e double").toPandas()
    model.scale = calibrate(np.log1p(points["e"].to_numpy()), points["y"].to_numpy(float))
    return model


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps, with a small ridge."""
    order = np.lexsort((y, x))  # sums in one order, so reruns agree to the last bit
    x, y = x[order], y[order]
    a = b = 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = p * (1 - p) + 1e-9
        g = np.array([np.sum(y - p) - 0.01 * ridge * a, np.sum((y - p) * x) - 0.01 * ridge * b])
        h = np.array([[np.sum(w) + 0.01 * ridge, np.sum(w * x)], [np.sum(w * x), np.sum(w * x * x) + 0.01 * ridge]])
        step = np.linalg.solve(h, g)
        size = np.max(np.abs(step))
        step *= min(1.0, 5.0 / size) if size else 1.0
        a, b = a + step[0], b + step[1]
        if size < 1e-10:
            break
    return float(a), float(b)


def held_out(doc_id: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_on_rest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> Toxicity:
    """Train on labelled rows that are not held out."""
    return train(docs, labels.where(~held_out(col(id_col))), id_col=id_col, **options)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
                   text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts score like texts
    without any insult, repeated rows get equal scores, an empty table gives none. Whole texts are
    read; columns other than id and text are not."""
    model = train_on_rest(docs, labels, id_col, text_col=text_col, **options)
    scored = docs.select(
        col(id_col).alias("doc_id"), held_out(col(id_col)).alias("held_out"), model.column(col(text_col)).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id",
               text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` under the threshold, all columns as they are."""
    model = train_on_rest(docs, labels, id_col, text_col=text_col, **options)
    return docs.where(model.column(col(text_col)) < threshold)
