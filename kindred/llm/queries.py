"""Registered queries of the operators, each over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from kindred.llm import (
    chat, hilbert, html_text, hyperminhash, line_dedup, mixing, packing, phrases, pii, quality, simhash, toxicity, whitening,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_main_text(_table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the text that is left, its lines and how many of them went."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select(
        "doc_id", "text", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat.with_forged_turns(_table(spark, sf_dir, "conversations"))
    return chat.read_back(chat.expand_conversations(turns))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(_table(spark, sf_dir, "embeddings"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(_table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").cast("long"))


def op12_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperminhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_mix_sources": op2_mix_sources,
    "op3_toxicity": op3_toxicity,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_personal_data": op6_personal_data,
    "op7_packing": op7_packing,
    "op8_chat": op8_chat,
    "op9_nearest": op9_nearest,
    "op10_quality": op10_quality,
    "op11_whitening": op11_whitening,
    "op12_hyperminhash": op12_hyperminhash,
    "op13_phrases": op13_phrases,
}

ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS key
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS ssize FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY 3 * ssize / w, source) AS k FROM r),
-- the first k sources are full, the others share the rest: the smallest k for which nobody is above
c AS (SELECT a.k, coalesce(sum(b.ssize) FILTER (b.k < a.k), 0) * 3 AS given, sum(b.w) FILTER (b.k >= a.k) AS open_w,
             (SELECT sum(ssize) FROM s) AS total
      FROM o a CROSS JOIN o b GROUP BY a.k),
f AS (SELECT min(c.k) AS k FROM c JOIN o ON o.k = c.k WHERE CAST(total - given AS DOUBLE) * o.w / open_w <= 3 * o.ssize),
t AS (SELECT o.source, o.ssize,
             CASE WHEN o.k < f.k THEN CAST(3 * o.ssize AS DOUBLE) ELSE CAST(c.total - c.given AS DOUBLE) * o.w / c.open_w END AS target
      FROM o, f JOIN c ON c.k = f.k),
p AS (SELECT *, CASE WHEN ssize > 0 THEN least(CAST(floor(target / ssize) AS BIGINT), 3) ELSE 0 END AS epochs FROM t),
q AS (SELECT d.doc_id, d.size, p.ssize, p.target, p.epochs, least(CAST(round(p.target) AS BIGINT), 3 * p.ssize) - p.epochs * p.ssize AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, ssize AS source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken, CAST(epochs AS BIGINT) AS epochs FROM q
""",
    "op4_line_dedup": r"""
WITH l AS (
  SELECT doc_id, i AS line, string_split(text, chr(10))[i] AS raw
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
w AS (SELECT doc_id, line, string_split(trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)), ' ') AS words
      FROM l WHERE trim(raw, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
first AS (SELECT words, len(words) AS n, min((doc_id, line)) AS pos FROM w GROUP BY words),
v AS (SELECT words, n, pos, i, list_concat(words[1:i - 1], words[i + 1:]) AS rest
      FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM first WHERE n >= 10)),
near AS (
  SELECT a.words FROM v a JOIN v b ON a.rest = b.rest AND a.i = b.i AND b.pos < a.pos
  UNION SELECT a.words FROM v a JOIN first b ON a.rest = b.words AND b.n >= 10 WHERE b.pos < a.pos
  UNION SELECT b.words FROM v a JOIN first b ON a.rest = b.words AND b.n >= 10 WHERE a.pos < b.pos),
gone AS (
  SELECT w.doc_id, w.line FROM w JOIN first f ON w.words = f.words
  WHERE (w.doc_id, w.line) > f.pos OR f.words IN (SELECT words FROM near)),
kept AS (
  SELECT l.doc_id, coalesce(string_agg(l.raw, chr(10) ORDER BY l.line) FILTER (g.line IS NULL), '') AS text, count(*) AS n_lines, count(g.line) AS n_dropped
  FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line = g.line GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op12_hyperminhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM w),
g AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM g a JOIN g b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
least AS (SELECT x AS doc_id, least(x, min(y)) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id,
       coalesce(l.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN least l ON l.doc_id = s.doc_id
""",
    "op13_phrases": r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
one AS (SELECT lang, x, count(*) AS f FROM (SELECT lang, unnest(w) AS x FROM w) GROUP BY lang, x),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, x[1] AS w1, x[2] AS w2, count(*) AS f
        FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i:i + 1])) AS x FROM w WHERE len(w) >= 2) GROUP BY ALL),
three AS (SELECT lang, x[1] AS w1, x[2] AS w2, x[3] AS w3, count(*) AS f
          FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) AS x FROM w WHERE len(w) >= 3) GROUP BY ALL HAVING count(*) >= 10),
inner_two AS (
  SELECT lang, w1, w2, max(f) AS longer
  FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
scored AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 AS phrase, t.f AS a, a.f AS l, b.f AS r,
         CAST(1000000::HUGEINT * t.f * t.f // (a.f::HUGEINT * b.f) AS BIGINT) AS score
  FROM two t JOIN one a ON a.lang = t.lang AND a.x = t.w1 JOIN one b ON b.lang = t.lang AND b.x = t.w2
  LEFT JOIN inner_two i ON i.lang = t.lang AND i.w1 = t.w1 AND i.w2 = t.w2
  WHERE t.f >= 10 AND coalesce(100 * i.longer < 50 * t.f, true)
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s2 < s1 THEN l2 ELSE l1 END, CASE WHEN s2 < s1 THEN r2 ELSE r1 END, least(s1, s2)
  FROM (
    SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, a.f AS l1, bc.f AS r1, ab.f AS l2, c.f AS r2,
           CAST(1000000::HUGEINT * t.f * t.f // (a.f::HUGEINT * bc.f) AS BIGINT) AS s1,
           CAST(1000000::HUGEINT * t.f * t.f // (ab.f::HUGEINT * c.f) AS BIGINT) AS s2
    FROM three t JOIN one a ON a.lang = t.lang AND a.x = t.w1 JOIN one c ON c.lang = t.lang AND c.x = t.w3
    JOIN two ab ON ab.lang = t.lang AND ab.w1 = t.w1 AND ab.w2 = t.w2
    JOIN two bc ON bc.lang = t.lang AND bc.w1 = t.w2 AND bc.w2 = t.w3)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
""",
}
