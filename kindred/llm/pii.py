"""Personal data by weak supervision.

Four kinds have an exact base definition (email, ip, card, phone) and always count. Beyond them,
wider patterns propose spans: long mixed tokens (secret), digit groups that fail the base checks
(number) and spelt-out addresses (contact). Labelers vote on every proposal: regular expressions,
gazetteers and context. Expectation-maximisation estimates from the agreement of the votes over
the whole corpus how reliable each labeler is; its posteriors then train a span classifier on
features of the span and its surroundings, which decides.

Texts are read once. Proposals are rare, and only they, not the texts, go through the later steps.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import col, written

BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("contact", "number", "secret")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY_DIGIT = re.compile(r"[0-9]")
_TOKEN_END = re.compile(r"[^A-Za-z0-9_/+-]|\Z")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+-")
_KEY_SHAPES = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_-]{35}|[sp]k[-_][0-9A-Za-z_-]{16,}|xox[bp]-[0-9A-Za-z-]{10,}")
_AT_DOMAIN = re.compile(r" ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)+", re.I)
_AT_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")

# gazetteers and cues
TLDS = frozenset("com org net edu gov io co uk de fr es it nl eu info biz ch at us ca".split())
KEY_STARTS = ("sk-", "sk_", "pk_", "ghp_", "gho_", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ", "glpat-")
SECRET_CUES = frozenset("token key secret password passwd pwd apikey api auth bearer credential schlüssel passwort clé clave contraseña jeton".split())
NUMBER_CUES = frozenset(
    "phone tel telephone call mobile cell fax card visa mastercard account iban ssn passport id number no nr "
    "telefon handy konto karte téléphone portable compte carte teléfono móvil cuenta tarjeta".split()
)
CONTACT_CUES = frozenset("mail email e-mail contact write reach kontakt schreib adresse courriel correo".split())
PASSWORD_CUES = frozenset("password passwd pwd passwort contraseña".split())
CUES = {"secret": SECRET_CUES, "number": NUMBER_CUES, "contact": CONTACT_CUES}

_AT_SIGN = re.compile(r"\(at\)|\[at\]", re.I)
_KEYS = re.compile(rf"(?<![A-Za-z0-9])(?:{_KEY_SHAPES.pattern}|(?:{'|'.join(KEY_STARTS)})[0-9A-Za-z_.-]{{12,}})(?![A-Za-z0-9])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_DOCUMENT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{1,2}[0-9]{6,9}(?![A-Za-z0-9])")  # passports, identity cards
_NATIONAL = re.compile(r"\d{3}-\d{2}-\d{4}|0\d{2,4}[ -]\d{3,}[ -]?\d{2,}|\d{3}-\d{3}-\d{4}|\d{4}(?:[ -]\d{4}){2,3}")
_BRACKETED = re.compile(r"\([0-9]{2,5}\)[ -]?[0-9]{2,}(?:[ -][0-9]{2,}){0,4}(?![0-9A-Za-z])")
# a cue, then a sign of assignment or a blank; values after a blank alone need a digit
_CUED = re.compile(
    rf"(?<!\w)(?:{'|'.join(sorted(SECRET_CUES, key=len, reverse=True))})(?:[\"']?[ \t]{{0,3}}[:=][ \t]{{0,3}}[\"']?|[ \t](?=[^\s\"',;]{{0,80}}[0-9]))"
    r"([^\s\"',;()<>\[\]{}]{4,200})", re.I,
)

LABELERS = ("pattern", "check", "gazetteer", "cue", "assigned", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d)
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping: letters before an @, then a domain with a dot.

    Looks from each @ to the left, so the work is linear however long a word is."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            done = m.end()
            at = text.find("@", done)
        else:
            done = max(done, at + 1)
            at = text.find("@", at + 1)
    return found


def spelt_out(text: str) -> list[tuple[int, int]]:
    """Addresses with (at) or [at] for the sign, leftmost and non-overlapping.

    Looks from each sign to the left, as ``emails`` does."""
    found, done = [], 0
    for sign in _AT_SIGN.finditer(text):
        if sign.start() < done:
            continue
        end = sign.start() - (sign.start() > done and text[sign.start() - 1] == " ")
        start = end
        while start > done and text[start - 1] in _AT_LOCAL:
            start -= 1
        if start < end and (m := _AT_DOMAIN.match(text, sign.end())):
            found.append((start, m.end()))
            done = m.end()
        else:
            done = sign.end()
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four base kinds, by kind as listed, then place."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _ANY_DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Wider candidates that don't touch a base span or each other: what the labelers' own patterns
    find in the text first, then values after a cue, then long tokens and groups of digits."""
    taken: list[tuple[int, int]] = []  # disjoint and in order
    for a, b in sorted((a, b) for _, a, b in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    sure = [("secret", m.start(), m.end()) for m in _KEYS.finditer(text)]
    sure += [("number", m.start(), m.end()) for p in (_IBAN, _BRACKETED) for m in p.finditer(text)]
    sure += [("number", m.start(), m.end()) for m in _DOCUMENT.finditer(text) if _cued(text, "number", m.start())[0]]
    sure += [("contact", a, b) for a, b in spelt_out(text)]
    cued = [("secret", m.start(1), m.start(1) + len(m[1].rstrip(".:!?"))) for m in _CUED.finditer(text)]
    cued = [c for c in cued if c[2] - c[1] >= 4]
    found: list[tuple[str, int, int]] = []
    done = 0
    for m in _DIGITS.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        left, right = start, end
        while left > done and text[left - 1] in _TOKEN:
            left -= 1
        right = _TOKEN_END.search(text, end - 1).start() if text[end - 1] in _TOKEN else end
        token = text[left:right]
        if right - left >= 12 and any(c.isalpha() for c in token) and " " not in token:
            found.append(("secret", left, right))
            done = right
        elif 7 <= sum(c not in " -" for c in m[0]) <= 19 and left == start and right == end:
            found.append(("number", start, end))
            done = end
    out = []
    for span in (s for group in (sure, cued, found) for s in sorted(group, key=lambda s: (s[1], s[0]))):
        i = bisect_left(taken, (span[2],))  # what starts before the span ends
        if i == 0 or taken[i - 1][1] <= span[1]:
            out.append(span)
            insort(taken, span[1:])
    return sorted(out, key=lambda s: (s[1], s[0]))


def _cued(text: str, kind: str, start: int) -> tuple[bool, bool, str]:
    """Whether one of the four words before a span is a cue, whether the span is assigned to
    something, and the last word."""
    before = text[max(0, start - 60) : start]
    near = [w.strip(".,:;=\"'()[]").lower() for w in before.split()][-4:]
    near = [w for w in near if w]
    return any(w in CUES[kind] for w in near), bool(re.search(r"[=:]\s*[\"']?$", before)), near[-1] if near else ""


def iban(bare: str) -> bool:
    """Whether the check digits of an IBAN are right."""
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{8,30}", bare)) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def _entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def votes_and_features(text: str, kind: str, start: int, end: int) -> tuple[list[int], list[float]]:
    """Votes of LABELERS (1 yes, -1 no, 0 abstains) and features for the classifier. A labeler abstains
    where it does not apply: check digits on numbers that have none, shapes on chosen passwords."""
    token = text[start:end]
    cue, assigned, last = _cued(text, kind, start)
    digits = sum("0" <= c <= "9" for c in token)
    letters = sum(c.isalpha() for c in token)
    bare = re.sub(r"[ ()-]", "", token)
    hexadecimal = bool(re.fullmatch(r"[0-9a-fA-F]+", token))
    entropy = _entropy(token)
    if kind == "secret":
        chosen = assigned and last in PASSWORD_CUES
        pattern = 1 if hexadecimal and len(token) >= 16 or _KEYS.fullmatch(token) else 0 if cue and assigned else -1
        check = 1 if hexadecimal and len(token) in (32, 40, 56, 64, 96, 128) else 0
        gazetteer = 1 if token.startswith(KEY_STARTS) else 0
        shape = 1 if entropy >= 2.8 and digits >= 2 else 0 if chosen or pattern == 1 else -1
    elif kind == "number":
        pattern = 1 if any(p.fullmatch(token) for p in (_NATIONAL, _BRACKETED, _IBAN, _DOCUMENT)) else -1
        checked = _IBAN.fullmatch(token) or bare.isdecimal() and 13 <= len(bare) <= 19
        check = 0 if not checked else 1 if iban(bare) or bare.isdecimal() and luhn(bare) else -1
        gazetteer = 1 if re.match(r"(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|00(?:1|3[3469]|4[149]|49))", bare) and len(bare) >= 11 else 0
        shape = 1 if len(set(bare)) >= 4 and bare not in "01234567890123456789" else -1
    else:
        pattern, check = 1, 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", token.rstrip("]) "))[-1].lower() in TLDS else -1
        shape = 1 if len(token) <= 60 else -1
    votes = [pattern, check, gazetteer, 1 if cue else 0 if assigned else -1, 1 if assigned else 0, shape]
    n = len(token)
    features = [
        float(kind == "secret"), float(kind == "number"), float(kind == "contact"), min(n, 64) / 64, digits / n, letters / n,
        entropy / 6, float(hexadecimal), float(cue), float(assigned), float(text[max(0, start - 1) : start] in ('"', "'")), float(" " in token),
        float(pattern), float(check), float(gazetteer), float(shape),
    ]
    return votes, features


FOUND = (
    "n_email long, n_ip long, n_card long, n_phone long, base string, "
    "more array<struct<kind:string,start:long,end:long,votes:array<int>,features:array<double>>>"
)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(text):
    """FOUND of a text column, one pass over whole texts."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                t = t or ""
                base = base_spans(t)
                kinds = Counter(k for k, _, _ in base)
                more = []
                for kind, a, b in proposals(t, base):
                    votes, features = votes_and_features(t, kind, a, b)
                    more.append({"kind": kind, "start": a, "end": b, "votes": votes, "features": features})
                rows.append((*(kinds[k] for k in BASE_KINDS), _joined(base), more))
            yield pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "more"])

    return run(text)


# What labelers are taken to be before anything is counted: the share of yes among their votes on
# real and on other spans, and how much that weighs, as a part of all proposals.
YES_ON_REAL, YES_ON_OTHER, BELIEF = 0.9, 0.2, 0.1


class Reliabilities:
    """How often each labeler says yes on real and on other spans, by expectation-maximisation over
    counted votes (-1, 0, 1 per labeler); who abstains says nothing.

    Where few labelers speak against a span, votes alone can't tell poor labelers from a wrong
    span. The belief that labelers are better than chance settles that; it is a part of the total,
    so tables of any size with the same shares are judged alike.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, tolerance: float = 1e-9):
        total = counts.sum()
        belief = BELIEF * total * np.array([YES_ON_REAL, YES_ON_OTHER])[:, None]
        yes, votes = (patterns > 0).astype(float), (patterns != 0).astype(float)
        real = np.where(patterns.sum(axis=1) > 0, 0.9, 0.1)  # start: the majority
        for _ in range(rounds):
            w = np.stack([real, 1 - real]) * counts
            self.share = (w.sum(axis=1) + BELIEF * total) / (total * (1 + 2 * BELIEF))
            self.rate = (w @ yes + belief) / (w @ votes + BELIEF * total)
            before, real = real, self.posterior(patterns)
            if np.abs(real - before).max() < tolerance:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of being real."""
        logs = np.log(self.share) + (patterns > 0) @ np.log(self.rate).T + (patterns < 0) @ np.log(1 - self.rate).T
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p[:, 0] / p.sum(axis=1)


def fit_classifier(features: np.ndarray, soft: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the offset."""
    x = np.hstack([features, np.ones((len(features), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (soft - p) - ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def find_personal_data(docs: DataFrame, least: float = 0.5, sample_rows: int = 20_000,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone (base spans), base (the
    base spans as kind:start:end, comma-joined, by kind as listed, then start), spans (base spans
    and those the classifier accepts, further kinds after the listed ones). Places are code
    points, ends exclusive.

    Null and empty texts have no spans. Repeated rows are searched each. An empty table gives
    none. EM counts the votes of all proposals; the classifier is trained on at most
    ``sample_rows`` of them, chosen by hash. Columns other than id and text are not read.
    """
    found = written(docs.select(col(id_col).alias("doc_id"), find_spans(col(text_col)).alias("f")).select("doc_id", "f.*"))
    more = found.where(F.size("more") > 0).select("doc_id", F.explode("more").alias("m")).select(
        "doc_id", "m.kind", "m.start", "m.votes", "m.features"
    )
    counts = more.groupBy("kind", "votes").count().collect()  # at most 3 * 3 ** 6 patterns
    weights = None
    if counts:
        counts = sorted((r["kind"], tuple(r["votes"]), r["count"]) for r in counts)
        models = {}  # a labeler may be right about one kind and wrong about another
        for kind in {c[0] for c in counts}:
            seen = [c for c in counts if c[0] == kind]
            models[kind] = Reliabilities(np.array([c[1] for c in seen]), np.array([c[2] for c in seen], float))
        sample = more.select("kind", "votes", "features", "doc_id", "start").orderBy(
            F.xxhash64("doc_id", "start", "features"), "features", "votes", "kind"
        ).limit(sample_rows).collect()
        soft = [models[r["kind"]].posterior(np.array([r["votes"]]))[0] for r in sample]
        weights = fit_classifier(np.array([r["features"] for r in sample]), np.array(soft))

    @F.pandas_udf("string")
    def merged(base: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for b, proposals_ in zip(base, more):
            spans = []
            for m in proposals_ if proposals_ is not None and weights is not None else ():
                odds = float(np.dot(m["features"], weights[:-1]) + weights[-1])
                if 1 / (1 + math.exp(-max(-500.0, min(500.0, odds)))) >= least:
                    spans.append((m["kind"], m["start"], m["end"]))
            spans.sort(key=lambda s: (MORE_KINDS.index(s[0]), s[1]))
            out.append(",".join(x for x in (b, _joined(spans)) if x))
        return pd.Series(out, dtype=object)

    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", merged("base", "more").alias("spans")
    )

