"""The same results as the queries, in DuckDB SQL over the same tables."""

from __future__ import annotations

from checks.queries import DOCUMENT_MODEL, PARTY_MODEL
from kindred.functions.text import WHITE_SPACE

# constants of the training, written out here so that the code under test can't define its own check
RECALL, START_TOP, LOWEST_M = 0.9, 0.95, 1e-9
TRAIN_ROUNDS, TOLERANCE = 25, 1e-4
TOP_LEVELS = {"exact": 1, "name": 4, "email": 4, "phone": 3, "date": 5}

_SPACES = "concat(" + ", ".join(f"chr({ord(c)})" for c in WHITE_SPACE) + ")"
TRIMMED_TEXT = f"lower(trim(text, {_SPACES}))"


# --- comparison levels --------------------------------------------------------------------------

def level_sql(kind: str, a: str, b: str) -> str:
    if kind == "exact":
        tests = f"WHEN {a} = {b} THEN 1"
    elif kind == "name":
        jw = f"jaro_winkler_similarity({a}, {b})"
        tests = (f"WHEN {a} = {b} THEN 4 WHEN {jw} >= 0.92 THEN 3 WHEN {jw} >= 0.88 THEN 2 "
                 f"WHEN {jw} >= 0.70 THEN 1")
    elif kind == "email":
        ua, ub = (f"regexp_extract({x}, '^[^@]+')" for x in (a, b))
        tests = (f"WHEN {a} = {b} THEN 4 WHEN {ua} = {ub} AND {ua} <> '' THEN 3 "
                 f"WHEN jaro_winkler_similarity({a}, {b}) >= 0.88 THEN 2 "
                 f"WHEN jaro_winkler_similarity({ua}, {ub}) >= 0.88 THEN 1")
    elif kind == "phone":
        tests = (f"WHEN {a} = {b} THEN 3 WHEN levenshtein({a}, {b}) <= 1 THEN 2 "
                 f"WHEN levenshtein({a}, {b}) <= 2 THEN 1")
    else:
        da, db = (f"try_strptime({x}, '%Y-%m-%d')::DATE" for x in (a, b))
        days = f"abs(datediff('day', {da}, {db}))"
        tests = (f"WHEN {da} IS NULL OR {db} IS NULL THEN -1 WHEN {a} = {b} THEN 5 "
                 f"WHEN damerau_levenshtein({a}, {b}) <= 1 THEN 4 WHEN {days} <= 30.4375 THEN 3 "
                 f"WHEN {days} <= 365.25 THEN 2 WHEN {days} <= 3652.5 THEN 1")
    return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN -1 {tests} ELSE 0 END)"


def weights_cte(kinds: dict[str, str]) -> str:
    """w: one row with the prior's and every level's weight, from trained(comparison, level, m, u, prior)."""
    parts = [
        f"max(log2(m / u)) FILTER (comparison = '{c}' AND level = {k}) AS w{i}_{k}"
        for i, (c, kind) in enumerate(kinds.items()) for k in range(TOP_LEVELS[kind] + 1)
    ]
    return f"w AS (SELECT log2(max(prior) / (1 - max(prior))) AS w_prior, {', '.join(parts)} FROM trained)"


def given_ctes(model) -> str:
    """trained and w for a model that was set by hand."""
    rows = ", ".join(
        f"('{c}', {k}, {model.m[c][k]!r}::DOUBLE, {model.u[c][k]!r}::DOUBLE, {model.prior!r}::DOUBLE)"
        for c, kind in model.comparisons.items() for k in range(TOP_LEVELS[kind] + 1)
    )
    return (f"trained AS (SELECT * FROM (VALUES {rows}) v(comparison, level, m, u, prior)), "
            + weights_cte(model.comparisons))


def weight_of(gamma: str, i: int, kind: str) -> str:
    whens = " ".join(f"WHEN {k} THEN w.w{i}_{k}" for k in range(TOP_LEVELS[kind] + 1))
    return f"(CASE {gamma} WHEN -1 THEN 0.0 {whens} END)::DOUBLE"


def weight_sql(kinds: dict[str, str], gammas: list[str]) -> str:
    return " + ".join(["w.w_prior", *(weight_of(g, i, k) for i, (g, k) in enumerate(zip(gammas, kinds.values())))])


# --- fuzzy dedup --------------------------------------------------------------------------------

def fuzzy_ctes(source: str, threshold: int, block_size: int) -> str:
    """``source``: a query of id and key. Ends in member(id, key, block, rep).

    LCS by the bit-vector recurrence, one character of the second text per recursion step; then
    the loop over keys in id order, one key per recursion step.
    """
    return f"""
  src AS ({source}),
  tok AS (SELECT id, lower(key) AS key, substring(lower(key), 1, {block_size}) AS block,
            array_to_string(list_sort(list_filter(
              regexp_split_to_array(lower(key), '\\s+'), lambda w: w <> '')), ' ') AS text
          FROM src),
  node AS (SELECT block, text, min(id) AS id FROM tok GROUP BY block, text),
  letter AS (SELECT id, unnest(range(0, length(text))) AS pos, text FROM node),
  mask AS (SELECT id, text[pos + 1] AS ch, sum(1::HUGEINT << pos::INT)::HUGEINT AS bits
           FROM letter GROUP BY ALL),
  d AS (SELECT a.id AS ia, b.id AS ib, length(a.text) AS la, b.text AS b, 0 AS i,
               ((1::HUGEINT << length(a.text)::INT) - 1)::HUGEINT AS v
        FROM node a JOIN node b ON a.block = b.block AND a.id < b.id
        UNION ALL
        SELECT ia, ib, la, b, i + 1,
               (((v + (v & coalesce(m.bits, 0::HUGEINT))) | (v - (v & coalesce(m.bits, 0::HUGEINT))))
                & ((1::HUGEINT << la::INT) - 1))::HUGEINT
        FROM d LEFT JOIN mask m ON m.id = d.ia AND m.ch = d.b[d.i + 1]
        WHERE i < length(b)),
  edge AS (SELECT ia, ib FROM d
           WHERE i = length(b)
             AND 200 * (la - bit_count(v)) >= {threshold} * (la + length(b))),
  near AS (SELECT node.id AS idx, row_number() OVER (ORDER BY node.id) AS rn,
             coalesce(list(ia ORDER BY ia) FILTER (ia IS NOT NULL), []) AS ns
           FROM node LEFT JOIN edge ON node.id = edge.ib GROUP BY node.id),
  g AS (SELECT rn, idx, idx AS rep, [idx] AS reps FROM near WHERE rn = 1
        UNION ALL
        SELECT n.rn, n.idx,
          coalesce(list_filter(n.ns, lambda q: list_contains(g.reps, q))[1], n.idx),
          CASE WHEN len(list_filter(n.ns, lambda q: list_contains(g.reps, q))) = 0
               THEN list_append(g.reps, n.idx) ELSE g.reps END
        FROM g JOIN near n ON n.rn = g.rn + 1),
  member AS (SELECT tok.id, tok.key, tok.block, g.rep
             FROM tok JOIN node ON tok.block = node.block AND tok.text = node.text
             JOIN g ON g.idx = node.id)"""


FUZZY_AUDIT = """
  SELECT row_number() OVER (ORDER BY start, rep) AS group_id, 'fuzzy' AS method, key,
         rep AS kept_index, removed AS removed_indices, n AS n_duplicates
  FROM (SELECT rep, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (id <> rep) AS removed,
               count(*) - 1 AS n, min(key) FILTER (id = rep) AS key,
               min(block) AS block
        FROM member GROUP BY rep HAVING count(*) > 1) x
  JOIN (SELECT block, min(id) AS start FROM member GROUP BY block) s USING (block)"""


def fuzzy_audit(source: str, threshold: int, block_size: int) -> str:
    return f"WITH RECURSIVE {fuzzy_ctes(source, threshold, block_size)} {FUZZY_AUDIT}"


JARO_WINKLER = "100.0::DOUBLE * jaro_winkler_similarity(a.text, b.text) >= {threshold}"


def levenshtein_ctes(source: str, threshold: int, block_size: int, test: str | None = None) -> str:
    """The same with 100 * (1 - edits / length of the longer key) as the score, or another ``test`` of a.text and b.text.

    levenshtein() counts bytes here, so the accented letters of the texts are first replaced by
    digits, which the texts don't hold.
    """
    edits = f"""100 * abs(length(a.text) - length(b.text)) <= {100 - threshold} * greatest(length(a.text), length(b.text))
             AND 100.0::DOUBLE * (greatest(length(a.text), length(b.text)) - levenshtein(translate(a.text, 'ßäçèéêíñóöü', '0123456789#'), translate(b.text, 'ßäçèéêíñóöü', '0123456789#')))
                 / greatest(length(a.text), length(b.text)) >= {threshold}"""
    return f"""
  src AS ({source}),
  tok AS (SELECT id, lower(key) AS key, substring(lower(key), 1, {block_size}) AS block FROM src),
  node AS (SELECT block, key AS text, min(id) AS id FROM tok GROUP BY block, key),
  edge AS (SELECT a.id AS ia, b.id AS ib FROM node a JOIN node b ON a.block = b.block AND a.id < b.id
           WHERE {test.format(threshold=threshold) if test else edits}),
  near AS (SELECT node.id AS idx, row_number() OVER (ORDER BY node.id) AS rn,
             coalesce(list(ia ORDER BY ia) FILTER (ia IS NOT NULL), []) AS ns
           FROM node LEFT JOIN edge ON node.id = edge.ib GROUP BY node.id),
  g AS (SELECT rn, idx, idx AS rep, [idx] AS reps FROM near WHERE rn = 1
        UNION ALL
        SELECT n.rn, n.idx, coalesce(list_filter(n.ns, lambda q: list_contains(g.reps, q))[1], n.idx),
          CASE WHEN len(list_filter(n.ns, lambda q: list_contains(g.reps, q))) = 0
               THEN list_append(g.reps, n.idx) ELSE g.reps END
        FROM g JOIN near n ON n.rn = g.rn + 1),
  member AS (SELECT tok.id, tok.key, tok.block, g.rep
             FROM tok JOIN node ON tok.block = node.block AND tok.key = node.text JOIN g ON g.idx = node.id)"""


TURN_KEYS = """
  SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, concat(role, ' | ', coalesce(text, '')) AS key
  FROM conversations"""
PART_KEYS = "SELECT p_partkey AS id, concat(p_name, ' | ', p_type) AS key FROM part"


# --- exact dedup --------------------------------------------------------------------------------

def exact_audit(table: str, id_: str, by: str, key: str, method: str = "exact") -> str:
    return f"""
  SELECT row_number() OVER (ORDER BY min(id)) AS group_id, '{method}' AS method,
         any_value(key) AS key, min(id) AS kept_index,
         array_to_string(list_sort(list(id))[2:], ',') AS removed_indices,
         count(*) - 1 AS n_duplicates
  FROM (SELECT {id_} AS id, {by} AS k, {key} AS key FROM {table})
  GROUP BY k HAVING count(*) > 1"""


EVENT_KEY = "(user_id, event_type)"
EVENT_TEXT = "concat(user_id, ' | ', event_type)"
EVENT_MEMBERS = f"""
  WITH a AS ({exact_audit('events', 'event_id', EVENT_KEY, EVENT_TEXT)})
  SELECT group_id, method, kept_index, unnest(string_split(removed_indices, ','))::BIGINT AS removed_index
  FROM a"""


# --- linkage ------------------------------------------------------------------------------------

PEOPLE = """
  people AS (SELECT c_custkey AS id, c_name AS name,
      concat(lower(regexp_replace(c_name, '#0*', '.')), '@', lower(c_mktsegment), '.example') AS email,
      c_acctbal::VARCHAR AS phone, c_mktsegment AS segment,
      c_nationkey AS nation FROM customer)"""


def people_levels(kind: str, column: str, grp: str = "concat(nation, '/', segment)") -> str:
    return f"""
  WITH {PEOPLE}, rec AS (SELECT id, {column} AS v, {grp} AS grp FROM people)
  SELECT l.id AS id_l, r.id AS id_r, {level_sql(kind, 'l.v', 'r.v')}::INT AS gamma
  FROM rec l JOIN rec r ON l.grp = r.grp AND l.id < r.id"""


DOCUMENT_RECORDS = """
  rec AS (SELECT min(doc_id) AS id, count(*) AS copies, md5(text) AS text, source, lang,
            n_chars::VARCHAR AS n_chars
          FROM documents GROUP BY md5(text), source, lang, n_chars)"""
DOCUMENT_PAIRS = f"""
  {DOCUMENT_RECORDS},
  cand AS (
    SELECT l.id AS id_l, r.id AS id_r, l.copies AS copies_l, r.copies AS copies_r,
           CASE WHEN l.text = r.text THEN 0 ELSE 1 END AS match_key,
           {level_sql('exact', 'l.text', 'r.text')} AS gamma_0,
           {level_sql('exact', 'l.source', 'r.source')} AS gamma_1,
           {level_sql('exact', 'l.lang', 'r.lang')} AS gamma_2,
           {level_sql('phone', 'l.n_chars', 'r.n_chars')} AS gamma_3
    FROM rec l JOIN rec r ON l.id < r.id AND (l.text = r.text OR l.n_chars = r.n_chars))"""
DOCUMENT_KINDS = {"text": "exact", "source": "exact", "lang": "exact", "n_chars": "phone"}
_DOC_WEIGHT = weight_sql(DOCUMENT_KINDS, [f"gamma_{i}" for i in range(4)])
_OWN_WEIGHT = weight_sql(DOCUMENT_KINDS, ["1", "1", "1", "3"])


def document_scored(weights: str) -> str:
    return f"""
  {weights},
  {DOCUMENT_PAIRS},
  weighed AS (SELECT cand.*, {_DOC_WEIGHT} AS match_weight FROM cand, w),
  scored AS (SELECT *, 1.0 / (1.0 + pow(2.0::DOUBLE, -match_weight)) AS match_probability
             FROM weighed WHERE 1.0 / (1.0 + pow(2.0::DOUBLE, -match_weight)) >= 0.9)"""


def document_clusters(weights: str) -> str:
    return document_scored(weights) + DOCUMENT_GROUPS


DOCUMENT_GROUPS = f""",
  own AS (SELECT id, p FROM (SELECT id, 1.0 / (1.0 + pow(2.0::DOUBLE, -({_OWN_WEIGHT}))) AS p
          FROM rec, w WHERE copies > 1) WHERE p >= 0.9),
  both_ways AS (SELECT id_l AS a, id_r AS b FROM scored UNION SELECT id_r, id_l FROM scored),
  reach AS (SELECT a AS id, a AS root FROM both_ways
            UNION
            SELECT e.b, reach.root FROM reach JOIN both_ways e ON e.a = reach.id),
  label AS (SELECT id, min(root) AS component FROM reach GROUP BY id
            UNION ALL SELECT id, id FROM own WHERE id NOT IN (SELECT id FROM reach)),
  sure AS (SELECT component, round_even(min(p), 4) AS match_probability
           FROM (SELECT id_l AS id, match_probability AS p FROM scored UNION ALL SELECT id, p FROM own)
           JOIN label USING (id) GROUP BY component),
  member AS (SELECT doc_id AS id, component, d.text, d.source, d.lang, d.n_chars
             FROM documents d JOIN rec ON md5(d.text) = rec.text AND d.source = rec.source
               AND d.lang = rec.lang AND d.n_chars::VARCHAR = rec.n_chars
             JOIN label ON label.id = rec.id)"""
DOCUMENT_AUDIT = """
  SELECT row_number() OVER (ORDER BY component) AS group_id, 'probabilistic' AS method,
         md5(key) AS key, component AS kept_index, removed AS removed_indices,
         n AS n_duplicates, match_probability
  FROM (SELECT component, string_agg(id::VARCHAR, ',' ORDER BY id) FILTER (id <> component) AS removed,
               count(*) - 1 AS n,
               min(concat(text, ' | ', source, ' | ', lang, ' | ', n_chars)) FILTER (id = component) AS key
        FROM member GROUP BY component HAVING count(*) > 1)
  JOIN sure USING (component)"""

PARTY_A = """
  SELECT c_custkey AS id, c_name AS name, c_nationkey::VARCHAR AS nation,
         floor(c_acctbal)::BIGINT::VARCHAR AS balance FROM customer"""
PARTY_B = """
  SELECT s_suppkey AS id, s_name AS name, s_nationkey::VARCHAR AS nation,
         floor(s_acctbal)::BIGINT::VARCHAR AS balance FROM supplier"""
PARTY_KINDS = {"name": "name", "nation": "exact", "balance": "phone"}
_PARTY_LEVELS = ", ".join(
    f"{level_sql(kind, f'l.{c}', f'r.{c}')} AS gamma_{i}" for i, (c, kind) in enumerate(PARTY_KINDS.items())
)


def party_pairs(weights: str) -> str:
    return f"""
  WITH {weights}, a AS ({PARTY_A}), b AS ({PARTY_B}),
  cand AS (SELECT l.id AS index_a, r.id AS index_b, {_PARTY_LEVELS}
           FROM a l JOIN b r ON l.nation = r.nation OR l.balance = r.balance),
  scored AS (SELECT *, 1.0 / (1.0 + pow(2.0::DOUBLE,
               -({weight_sql(PARTY_KINDS, ['gamma_0', 'gamma_1', 'gamma_2'])}))) AS p FROM cand, w)
  SELECT index_a, index_b, round_even(p, 4) AS match_probability FROM scored WHERE p >= 0.3"""


# --- training -----------------------------------------------------------------------------------

SUPPLIER_KINDS = {"name": "name", "nation": "exact", "balance": "phone"}


def start_m(kind: str) -> list[float]:
    top = TOP_LEVELS[kind]
    return [(1 - START_TOP) / top] * top + [START_TOP]


def training_ctes(source: str, kinds: dict[str, str], blocking: list[str], other: str | None = None) -> str:
    """trained(comparison, level, m, u, prior) and w: prior, u, and EM with its stop rule, round by round.

    ``other``: the second table of a link run. Valid while all pairs of rows are at most a million,
    the product's bound for random pairs.
    """
    cols = list(kinds)
    gammas = ", ".join(f"{level_sql(k, f'l.{c}', f'r.{c}')} AS g{i}" for i, (c, k) in enumerate(kinds.items()))
    equals = ", ".join(f"coalesce(l.{c} = r.{c}, false) AS e{j}" for j, c in enumerate(blocking))
    any_equal = " OR ".join(f"e{j}" for j in range(len(blocking)))
    levels = [(i, k) for i, c in enumerate(cols) for k in range(TOP_LEVELS[kinds[c]] + 1)]
    u = ", ".join(
        f"greatest(count(*) FILTER (g{i} = {k}) / greatest(count(*) FILTER (g{i} >= 0), 1)::DOUBLE, "
        f"0.5 / count(*)) AS u{i}_{k}"
        for i, k in levels
    )
    shares = ", ".join(f"count(*) FILTER (e{j}) / count(*)::DOUBLE AS share{j}" for j in range(len(blocking)))
    joined = "r0 l, r1 r" if other else "r0 l JOIN r0 r ON l.id < r.id"
    out = [f"r0 AS ({source})", *([f"r1 AS ({other})"] if other else [])]
    out += [
        f"p AS MATERIALIZED (SELECT {gammas}, {equals} FROM {joined})",
        f"u AS MATERIALIZED (SELECT count(*) AS total, {u}, {shares}, "
        f"least(greatest(count(*) FILTER ({any_equal}) / {RECALL} / count(*), 1e-12), 1 - 1e-6) AS prior FROM p)",
        f"pat AS MATERIALIZED (SELECT *, count(*) AS n FROM p WHERE {any_equal} GROUP BY ALL)",
    ]
    starts = {c: start_m(kind) for c, kind in kinds.items()}
    free = {j: [i for i, c in enumerate(cols) if c != fixed] for j, fixed in enumerate(blocking)}
    for j, fixed in enumerate(blocking):
        by_chance = f"u{cols.index(fixed)}_{TOP_LEVELS[kinds[fixed]]}" if fixed in cols else f"share{j}"
        mine = [(i, k) for i, k in levels if i in free[j]]
        first = ", ".join(f"{starts[cols[i]][k]!r}::DOUBLE AS m{i}_{k}" for i, k in mine)
        out.append(
            f"s{j}_0 AS (SELECT o / (1 + o) AS odds, false AS done, {first} FROM "
            f"(SELECT prior / (1 - prior) * {START_TOP} / {by_chance} AS o FROM u) "
            f"WHERE EXISTS (SELECT 1 FROM pat WHERE e{j}))"
        )
        terms = "".join(
            f" + CASE g{i} " + " ".join(f"WHEN {k} THEN ln(s.m{i}_{k} / u.u{i}_{k})" for i2, k in mine if i2 == i)
            + " ELSE 0 END"
            for i in free[j]
        )
        olds = ", ".join(f"any_value(m{i}_{k}) AS m{i}_{k}" for i, k in mine)
        news = ", ".join(
            f"CASE WHEN sum(w) FILTER (g{i} >= 0) > 0 THEN greatest(coalesce(sum(w) FILTER (g{i} = {k}), 0) / "
            f"sum(w) FILTER (g{i} >= 0), {LOWEST_M}) ELSE any_value(m{i}_{k}) END AS n{i}_{k}"
            for i, k in mine
        )
        taken = ", ".join(f"CASE WHEN done THEN m{i}_{k} ELSE n{i}_{k} END AS m{i}_{k}" for i, k in mine)
        moved = ", ".join(f"abs(n{i}_{k} - m{i}_{k})" for i, k in mine)
        for r in range(1, TRAIN_ROUNDS + 1):
            out.append(
                f"s{j}_{r} AS MATERIALIZED (SELECT CASE WHEN done THEN odds ELSE new_odds END AS odds, "
                f"done OR greatest(abs(new_odds - odds), {moved}) < {TOLERANCE} AS done, {taken} FROM ("
                f"SELECT any_value(odds) AS odds, any_value(done) AS done, {olds}, "
                f"least(greatest(sum(w) / sum(n), 1e-12), 1 - 1e-12) AS new_odds, {news} "
                f"FROM (SELECT pat.*, s.*, pat.n / (1 + exp(-(ln(s.odds / (1 - s.odds)){terms}))) AS w "
                f"FROM pat, s{j}_{r - 1} s, u WHERE pat.e{j}) HAVING count(*) > 0))"
            )
    found = " UNION ALL ".join(
        f"SELECT {i} AS c, {k} AS k, (SELECT m{i}_{k} FROM s{j}_{TRAIN_ROUNDS} "
        f"WHERE EXISTS (SELECT 1 FROM pat WHERE e{j} AND g{i} = {k})) AS m, {starts[cols[i]][k]!r} AS start"
        if i in free[j] else f"SELECT {i} AS c, {k} AS k, NULL AS m, {starts[cols[i]][k]!r} AS start"
        for i, k in levels for j in range(len(blocking))
    )
    out.append(f"found AS ({found})")
    out.append(
        "share AS (SELECT c, k, greatest(coalesce(median(m), any_value(start)), "
        f"{LOWEST_M}) AS m FROM found GROUP BY c, k)"
    )
    names = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(cols))
    us = " UNION ALL ".join(f"SELECT {i} AS c, {k} AS k, u{i}_{k} AS u FROM u" for i, k in levels)
    out.append(
        f"trained AS MATERIALIZED (SELECT CASE share.c {names} END AS comparison, share.k AS level, "
        f"share.m / sum(share.m) OVER (PARTITION BY share.c) AS m, x.u, u.prior "
        f"FROM share JOIN ({us}) x ON x.c = share.c AND x.k = share.k, u)"
    )
    out.append(weights_cte(kinds))
    return ",\n  ".join(out)


def sampled_shares(source: str, kinds: dict[str, str], rows: int, seed: int = 42) -> str:
    """u when only ``rows`` rows, chosen by md5, are paired: equality from all rows, the rest in proportion."""
    gammas = ", ".join(f"{level_sql(k, f'l.{c}', f'r.{c}')} AS g{i}" for i, (c, k) in enumerate(kinds.items()))
    parts = []
    for i, (c, kind) in enumerate(kinds.items()):
        top = TOP_LEVELS[kind]
        same = (f"(SELECT sum(n * (n - 1) / 2)::DOUBLE / (any_value(t) * (any_value(t) - 1) / 2) FROM "
                f"(SELECT count(*) AS n, any_value((SELECT count({c}) FROM r0)) AS t FROM r0 WHERE {c} IS NOT NULL GROUP BY {c}))")
        below = f"greatest(count(*) FILTER (g{i} BETWEEN 0 AND {top - 1}), 1)::DOUBLE"
        for k in range(top + 1):
            share = same if k == top else f"count(*) FILTER (g{i} = {k}) / {below} * (1.0 - {same})"
            parts.append(f"SELECT '{c}' AS comparison, {k} AS level, round_even(greatest({share}, 0.5 / count(*)), 8) AS u FROM p")
    return f"""
      WITH r0 AS ({source}),
      few AS (SELECT * FROM r0 ORDER BY md5(concat(id, ':{seed}')), id LIMIT {rows}),
      p AS MATERIALIZED (SELECT {gammas} FROM few l JOIN few r ON l.id < r.id)
      {' UNION ALL '.join(parts)}"""


SUPPLIERS_TRAINED = training_ctes(PARTY_B, PARTY_KINDS, list(PARTY_KINDS))
DOCUMENTS_TRAINED = training_ctes(
    "SELECT doc_id AS id, md5(text) AS text, source, lang, n_chars::VARCHAR AS n_chars FROM documents",
    DOCUMENT_KINDS, ["text", "n_chars"],
)
PARTIES_TRAINED = training_ctes(PARTY_A, PARTY_KINDS, ["nation", "balance"], PARTY_B)
DOCUMENTS_GIVEN, PARTIES_GIVEN = given_ctes(DOCUMENT_MODEL), given_ctes(PARTY_MODEL)

LEVEL_LABELS = {
    "exact": ("different", "equal"),
    "phone": ("different", "Levenshtein <= 2", "Levenshtein <= 1", "equal"),
    "name": (
        "different", "Jaro-Winkler >= 0.70", "Jaro-Winkler >= 0.88", "Jaro-Winkler >= 0.92", "equal",
    ),
}


def _label(level: str, kind: str) -> str:
    return f"CASE {level} WHEN -1 THEN 'missing' " + " ".join(
        f"WHEN {k} THEN '{t}'" for k, t in enumerate(LEVEL_LABELS[kind])) + " END"


def _explain() -> str:
    return " UNION ALL ".join(
        f"SELECT id_l, id_r, '{c}' AS comparison, gamma_{i} AS level, {_label(f'gamma_{i}', kind)} AS label, "
        f"round_even({weight_of(f'gamma_{i}', i, kind)}, 6) AS log2_weight FROM scored, w"
        for i, (c, kind) in enumerate(DOCUMENT_KINDS.items())
    )


def _null_share(position: int, column: str, dtype: str) -> str:
    return (f"SELECT {position} AS position, '{column}' AS \"column\", '{dtype}' AS dtype, "
            f"round_even(100.0::DOUBLE * count(*) FILTER ({column} IS NULL) / count(*), 2) AS null_pct FROM t")


_LABELLED = {
    "doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint",
    "quality": "int", "toxic": "int",
}

ORACLES = {
    "profile_summary_events": """
      SELECT (SELECT count(*) FROM events) AS n_rows, 6 AS n_cols,
             (SELECT count(*) FROM events) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS exact_duplicates""",
    "profile_dup_rows_part": """
      WITH t AS (SELECT p_name, p_brand, p_type, p_size FROM part)
      SELECT (SELECT count(*) FROM t) AS n_rows, 4 AS n_cols,
             (SELECT count(*) FROM t) - (SELECT count(*) FROM (SELECT DISTINCT * FROM t)) AS exact_duplicates""",
    "profile_columns_labelled_documents":
        "WITH t AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)) "
        + " UNION ALL ".join(_null_share(i, c, t) for i, (c, t) in enumerate(_LABELLED.items())),
    "normalize_customer_name": """
      SELECT c_custkey, lower(trim(c_name)) AS c_name, lower(c_mktsegment) AS c_mktsegment FROM customer""",
    "normalize_email_like_urls": "SELECT page_id, lower(trim(url)) AS url FROM pages",
    "normalize_phone_digits_documents":
        "SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS text FROM documents",
    "normalize_trim_documents": f"SELECT doc_id, md5(trim(text, {_SPACES})) AS text FROM documents",
    "normalize_nulls_labelled_documents": """
      SELECT doc_id, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic
      FROM documents LEFT JOIN labels USING (doc_id)""",
    "row_ids_orders": """
      SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS _row_id, o_orderkey FROM orders""",
    "combined_key_part": """
      SELECT p_partkey, concat(p_name, ' | ', p_type, ' | ', p_size) AS key FROM part""",
    "preview_customer": "SELECT *, c_custkey AS _row_id FROM customer ORDER BY c_custkey LIMIT 50",
    "common_columns_parties": f"""
      SELECT id, name, nation::INT AS nation, balance FROM ({PARTY_A})
      UNION ALL SELECT id, name, nation::INT, balance FROM ({PARTY_B})""",
    "dedup_exact_documents": f"""
      SELECT doc_id, md5(t) AS text, lang, source, n_chars FROM (
        SELECT *, {TRIMMED_TEXT} AS t, row_number() OVER (PARTITION BY {TRIMMED_TEXT} ORDER BY doc_id) AS rn
        FROM documents) WHERE rn = 1""",
    "dedup_exact_audit_documents":
        exact_audit("documents", "doc_id", TRIMMED_TEXT, f"md5({TRIMMED_TEXT})"),
    "dedup_exact_events_multi_key": """
      SELECT event_id, ts, user_id, event_type, value, props FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
      WHERE rn = 1""",
    "audit_members_events": EVENT_MEMBERS,
    "audit_members_from_audit_events": EVENT_MEMBERS,
    "dedup_summary_events": """
      SELECT n_in, n_in - n_out AS n_removed, n_out FROM (
        SELECT count(*) AS n_in, count(DISTINCT (user_id, event_type)) AS n_out FROM events)""",
    "block_pairs_part": f"""
      WITH n AS (SELECT lower(key) AS key, substring(lower(key), 1, 1) AS block, min(id) AS id
                 FROM ({PART_KEYS}) GROUP BY ALL)
      SELECT l.block, l.id AS id_l, r.id AS id_r FROM n l JOIN n r ON l.block = r.block AND l.id < r.id""",
    "block_forecast_part": f"""
      SELECT block, n AS n_rows, n * (n - 1) // 2 AS n_pairs FROM (
        SELECT substring(lower(key), 1, 1) AS block, count(*) AS n FROM ({PART_KEYS}) GROUP BY 1)""",
    "block_forecast_documents": """
      SELECT lang, n AS n_rows, n * (n - 1) // 2 AS n_pairs FROM (
        SELECT lang, count(*) AS n FROM documents GROUP BY 1)""",
    "token_sort_ratio_part": f"""
      WITH RECURSIVE {fuzzy_ctes("SELECT p_partkey AS id, p_name AS key FROM part", 0, 1)}, 
      k AS (SELECT key, block, text, min(id) AS id FROM tok GROUP BY ALL),
      s AS (SELECT ia, ib, 200.0::DOUBLE * (la - bit_count(v)) / (la + length(b)) AS score FROM d WHERE i = length(b)),
      node_of AS (SELECT k.*, node.id AS nid FROM k JOIN node ON k.block = node.block AND k.text = node.text)
      SELECT l.key AS key_l, r.key AS key_r,
             round_even(CASE WHEN l.nid = r.nid THEN 100.0 ELSE s.score END, 6) AS score
      FROM node_of l JOIN node_of r ON l.block = r.block AND l.id < r.id
      LEFT JOIN s ON s.ia = least(l.nid, r.nid) AND s.ib = greatest(l.nid, r.nid)""",
    "dedup_fuzzy_part": f"""
      WITH RECURSIVE {fuzzy_ctes(PART_KEYS, 85, 1)}
      SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part
      WHERE p_partkey IN (SELECT id FROM member WHERE id = rep)""",
    "dedup_fuzzy_audit_part": fuzzy_audit(PART_KEYS, 85, 1),
    "dedup_fuzzy_audit_urls": fuzzy_audit("SELECT page_id AS id, url AS key FROM pages", 90, 8),
    "dedup_fuzzy_customer_names":
        fuzzy_audit("SELECT c_custkey AS id, c_name AS key FROM customer", 94, 1),
    "dedup_fuzzy_levenshtein_part": f"WITH RECURSIVE {levenshtein_ctes(PART_KEYS, 80, 2)} {FUZZY_AUDIT}",
    "dedup_fuzzy_levenshtein_conversations": f"""
      WITH RECURSIVE {levenshtein_ctes(TURN_KEYS, 35, 13)}
      SELECT * REPLACE (md5(key) AS key) FROM ({FUZZY_AUDIT})""",
    "dedup_fuzzy_batch_part": f"WITH RECURSIVE {levenshtein_ctes(PART_KEYS, 93, 1, JARO_WINKLER)} {FUZZY_AUDIT}",
    "clean_exact_then_fuzzy_part": f"""
      WITH RECURSIVE
      keyed AS (SELECT p_partkey AS id, concat(lower(trim(p_name)), ' | ', p_type) AS key FROM part),
      first_stage AS ({exact_audit('keyed', 'id', 'key', 'key')}),
      {fuzzy_ctes("SELECT min(id) AS id, key FROM keyed GROUP BY key", 85, 1)},
      second_stage AS ({FUZZY_AUDIT})
      SELECT * FROM first_stage
      UNION ALL
      SELECT group_id + (SELECT coalesce(max(group_id), 0) FROM first_stage), method, key, kept_index,
             removed_indices, n_duplicates FROM second_stage""",
    "audit_union": f"""
      WITH RECURSIVE {document_clusters(DOCUMENTS_GIVEN)},
      e AS ({exact_audit('events', 'event_id', EVENT_KEY, f'md5({EVENT_TEXT})')})
      SELECT *, NULL::DOUBLE AS match_probability FROM e UNION ALL BY NAME ({DOCUMENT_AUDIT})""",
    "compare_exact_people": people_levels("exact", "segment", "nation"),
    "compare_name_people": people_levels("name", "name"),
    "compare_email_people": people_levels("email", "email"),
    "compare_phone_people": people_levels("phone", "phone"),
    "compare_date_orders": f"""
      WITH o AS (SELECT o_orderkey AS id, o_custkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders)
      SELECT l.id AS id_l, r.id AS id_r, {level_sql('date', 'l.v', 'r.v')}::INT AS gamma
      FROM o l JOIN o r ON l.o_custkey = r.o_custkey AND l.id < r.id""",
    "candidate_pairs_documents":
        f"WITH {DOCUMENT_PAIRS} SELECT id_l, id_r, copies_l, copies_r, match_key FROM cand",
    "rule_forecast_documents": """
      WITH t AS (SELECT DISTINCT md5(text) AS text, source, lang, n_chars FROM documents),
      i AS (SELECT *, row_number() OVER (ORDER BY text, source, lang, n_chars) AS id FROM t),
      p AS (SELECT coalesce(l.source = r.source, false) AS s, coalesce(l.lang = r.lang, false) AS g,
                   coalesce(l.n_chars = r.n_chars, false) AS n FROM i l JOIN i r ON l.id < r.id)
      SELECT 0 AS match_key, count(*) FILTER (s) AS equal_pairs, count(*) FILTER (s) AS n_pairs FROM p
      UNION ALL SELECT 1, count(*) FILTER (g), count(*) FILTER (g AND NOT s) FROM p
      UNION ALL SELECT 2, count(*) FILTER (n), count(*) FILTER (n AND NOT s AND NOT g) FROM p""",
    "rule_forecast_parties": f"""
      WITH a AS ({PARTY_A}), b AS ({PARTY_B}),
      p AS (SELECT coalesce(l.nation = r.nation, false) AS n, coalesce(l.balance = r.balance, false) AS m
            FROM a l CROSS JOIN b r)
      SELECT 0 AS match_key, count(*) FILTER (n) AS equal_pairs, count(*) FILTER (n) AS n_pairs FROM p
      UNION ALL SELECT 1, count(*) FILTER (m), count(*) FILTER (m AND NOT n) FROM p""",
    "link_factors_events": """
      WITH g AS (SELECT event_type, user_id, floor(value / 50) AS step, min(event_id) AS id, count(*) AS n FROM events
                 WHERE user_id IS NOT NULL AND value IS NOT NULL GROUP BY ALL)
      SELECT a.id AS record_a, b.id AS record_b, a.n AS copies_a, b.n AS copies_b, a.n * b.n AS n_links
      FROM g a JOIN g b USING (user_id, step) WHERE a.event_type = 'click' AND b.event_type = 'purchase'""",
    "numbered_lineitem": """
      SELECT count(*) AS n_rows, count(*) AS n_same, 0::BIGINT AS least, count(*) - 1 AS greatest, count(*) AS n_ids
      FROM lineitem""",
    "link_candidates_parties": f"""
      WITH a AS ({PARTY_A}), b AS ({PARTY_B})
      SELECT l.id AS id_l, r.id AS id_r, CASE WHEN l.nation = r.nation THEN 0 ELSE 1 END AS match_key
      FROM a l JOIN b r ON l.nation = r.nation OR l.balance = r.balance""",
    "prior_documents": f"""
      WITH t AS (SELECT doc_id, md5(text) AS text, n_chars FROM documents),
      n AS (SELECT count(*) FILTER (l.text = r.text OR l.n_chars = r.n_chars) AS agreeing,
                   count(*) FILTER (l.text = r.text) AS equal_text,
                   count(*) FILTER (l.n_chars = r.n_chars) AS equal_n_chars
            FROM t l JOIN t r ON l.doc_id < r.doc_id),
      c AS (SELECT count(*) AS rows FROM t)
      SELECT agreeing, equal_text, equal_n_chars,
             round_even(agreeing / {RECALL}::DOUBLE / (rows * (rows - 1) // 2), 10) AS prior FROM n, c""",
    "agreement_patterns_documents": """
SELECT CASE WHEN a.source = b.source THEN 1 ELSE 0 END + CASE WHEN a.n_chars = b.n_chars THEN 2 ELSE 0 END AS agree,
       CASE WHEN a.lang IS NULL OR b.lang IS NULL THEN -1 WHEN a.lang = b.lang THEN 1 ELSE 0 END AS gamma_0,
       CASE WHEN a.source IS NULL OR b.source IS NULL THEN -1 WHEN a.source = b.source THEN 1 ELSE 0 END AS gamma_1,
       CASE WHEN a.n_chars IS NULL OR b.n_chars IS NULL THEN -1 WHEN a.n_chars = b.n_chars THEN 1 ELSE 0 END AS gamma_2,
       count(*) AS pairs
FROM documents a JOIN documents b ON a.doc_id < b.doc_id AND (a.source = b.source OR a.n_chars = b.n_chars)
GROUP BY ALL
""",
    "prior_parties": f"""
      WITH a AS ({PARTY_A}), b AS ({PARTY_B})
      SELECT count(*) FILTER (l.nation = r.nation OR l.balance = r.balance) AS agreeing,
             count(*) FILTER (l.nation = r.nation) AS equal_nation,
             count(*) FILTER (l.balance = r.balance) AS equal_balance
      FROM a l, b r""",
    "u_shares_suppliers": f"""
      WITH {SUPPLIERS_TRAINED} SELECT comparison, level, round_even(u, 8) AS u FROM trained""",
    # 5,000 pairs at most: 100 rows make 4,950
    "u_shares_sampled_customers": sampled_shares(PARTY_A, PARTY_KINDS, 1414),
    "trained_weights_suppliers": f"""
      WITH {SUPPLIERS_TRAINED}
      SELECT comparison, level,
             CASE comparison WHEN 'name' THEN {_label('level', 'name')} WHEN 'nation' THEN {_label('level', 'exact')}
                  ELSE {_label('level', 'phone')} END AS label,
             round_even(m, 6) AS m, round_even(u, 6) AS u, round_even(m / u, 4) AS bayes_factor,
             round_even(log2(m / u), 5) AS log2_weight, round_even(prior, 8) AS prior
      FROM trained""",
    "predict_fixed_weights_documents": f"""
      WITH {document_scored(DOCUMENTS_GIVEN)}
      SELECT id_l, id_r, gamma_0, gamma_1, gamma_2, gamma_3, round_even(match_weight, 6) AS match_weight,
             round_even(match_probability, 6) AS match_probability FROM scored""",
    "cluster_documents": """
      WITH RECURSIVE t AS (SELECT doc_id AS id, md5(text) AS text, source, n_chars FROM documents),
      e AS (SELECT l.id AS a, r.id AS b FROM t l JOIN t r ON l.id <> r.id
            AND (l.text = r.text OR (l.source = r.source AND l.n_chars = r.n_chars))),
      reach AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, reach.root FROM reach JOIN e ON e.a = reach.id)
      SELECT id AS node, min(root) AS component FROM reach GROUP BY id""",
    "cluster_all_documents": """
      SELECT doc_id AS node, min(doc_id) OVER (PARTITION BY source, n_chars) AS component FROM documents""",
    "dedupe_prob_audit_documents": f"WITH RECURSIVE {document_clusters(DOCUMENTS_GIVEN)} {DOCUMENT_AUDIT}",
    "dedupe_trained_documents": f"WITH RECURSIVE {document_clusters(DOCUMENTS_TRAINED)} {DOCUMENT_AUDIT}",
    "dedupe_prob_clean_documents": f"""
      WITH RECURSIVE {document_clusters(DOCUMENTS_GIVEN)}
      SELECT doc_id, lang, source, n_chars FROM documents
      WHERE doc_id NOT IN (SELECT id FROM member WHERE id <> component)""",
    "link_pairs_parties": party_pairs(PARTIES_GIVEN),
    "link_trained_parties": party_pairs(PARTIES_TRAINED),
    "link_audit_parties": f"SELECT 'link' AS method, * FROM ({party_pairs(PARTIES_GIVEN)})",
    "dedupe_certain_documents": "SELECT 0::BIGINT AS n_groups, count(*) AS n_kept FROM documents",
    "linkage_plan_documents": """
      SELECT 0 AS match_key, 'text' AS equal, '' AS not_equal, count(text) AS n_rows, 0.9::DOUBLE AS threshold FROM documents
      UNION ALL SELECT 1, 'n_chars', 'text', count(n_chars), 0.9::DOUBLE FROM documents""",
    "explain_pairs_documents": f"WITH {document_scored(DOCUMENTS_GIVEN)} {_explain()}",
    "csv_round_trip_customer": "SELECT * FROM customer",
    "csv_round_trip_conversations":
        "SELECT conv_id, turn, role, md5(text) AS text FROM conversations",
    "parquet_round_trip_events": "SELECT * FROM events",
    "written_result_events": """
      WITH g AS (SELECT min(event_id) AS kept, count(*) AS n FROM events GROUP BY user_id, event_type)
      SELECT count(*) FILTER (n > 1) AS n_groups, (sum(n - 1) FILTER (n > 1))::BIGINT AS n_removed,
             count(*) AS n_kept, sum(kept)::BIGINT AS sum_ids FROM g""",
    "csv_with_schema_customer": "SELECT * FROM customer",
    # what is refused: errors by case, counts where a case is accepted
    "empty_sources_customer": """
      WITH s AS (SELECT 'all' AS name, count(*) AS n FROM customer
                 UNION ALL SELECT 'in debt', count(*) FROM customer WHERE c_acctbal < 0
                 UNION ALL SELECT 'none', count(*) FROM customer WHERE c_acctbal > 1e12)
      SELECT name, CASE WHEN n = 0 THEN 'EmptyDataError' END AS error, CASE WHEN n > 0 THEN n END AS n_rows FROM s""",
    "normalize_checked_customer": f"""
      SELECT 'trim' AS name, NULL::VARCHAR AS error, sum(length(trim(coalesce(c_name, ''), {_SPACES})))::BIGINT AS n_chars FROM customer
      UNION ALL SELECT 'lowercase', NULL, sum(length(lower(coalesce(c_name, ''))))::BIGINT FROM customer
      UNION ALL SELECT 'email', NULL, sum(length(lower(trim(coalesce(c_name, ''), {_SPACES}))))::BIGINT FROM customer
      UNION ALL SELECT 'phone', NULL, sum(length(regexp_replace(coalesce(c_name, ''), '[^0-9]', '', 'g')))::BIGINT FROM customer
      UNION ALL SELECT 'uppercase', 'CleaningError', NULL
      UNION ALL SELECT 'no such column', 'ColumnNotFoundError', NULL""",
    "keys_checked_documents": """
      SELECT 'lang' AS name, NULL::VARCHAR AS error, count(*) AS n_kept FROM (SELECT DISTINCT coalesce(lang, '') FROM documents)
      UNION ALL SELECT 'lang, source', NULL, count(*) FROM (SELECT DISTINCT coalesce(lang, ''), coalesce(source, '') FROM documents)
      UNION ALL SELECT 'none', 'InvalidConfigError', NULL
      UNION ALL SELECT 'author', 'ColumnNotFoundError', NULL
      UNION ALL SELECT 'lang, author', 'ColumnNotFoundError', NULL""",
    "linkage_configs_documents": """
      SELECT 'good' AS name, NULL::VARCHAR AS error, sum(n * (n - 1) / 2)::BIGINT AS n_pairs
      FROM (SELECT count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY n_chars)
      UNION ALL SELECT 'nothing to compare', 'InvalidConfigError', NULL
      UNION ALL SELECT 'unknown comparison', 'InvalidConfigError', NULL
      UNION ALL SELECT 'unknown column', 'ColumnNotFoundError', NULL
      UNION ALL SELECT 'unknown blocking column', 'ColumnNotFoundError', NULL
      UNION ALL SELECT 'threshold of zero', 'InvalidConfigError', NULL""",
    "threshold_cap_documents": f"""
      WITH {document_scored(DOCUMENTS_GIVEN)},
      t AS (SELECT * FROM (VALUES (NULL::DOUBLE, 0.9::DOUBLE), (0.95, 0.95), (0.999, 0.999), (1.0, 0.999)) v(asked, threshold))
      SELECT asked, threshold, 42::BIGINT AS seed, count(id_l) AS n_pairs
      FROM t LEFT JOIN scored ON match_probability >= threshold GROUP BY asked, threshold""",
    "training_refusals_documents": f"""
      WITH g AS (SELECT count(*) AS n FROM documents WHERE n_chars IS NOT NULL GROUP BY n_chars)
      SELECT 'good' AS name, NULL::VARCHAR AS error,
             round(sum(n * (n - 1) / 2) / {RECALL} / (SELECT count(*) * (count(*) - 1) / 2 FROM documents), 10)::DOUBLE AS prior FROM g
      UNION ALL SELECT 'no equal values', 'CleaningError', NULL
      UNION ALL SELECT 'nothing but the block', 'CleaningError', NULL""",
}
