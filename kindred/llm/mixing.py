"""Mixing sources to target weights: hash keys, range order, distributed prefix sums, exact cuts.

Every document gets a hash-random key. Within a source the documents stand in key order, and equal
key ranges are its partitions. The sum of each range, and their running sum per source, say
between which ranges the source's budget falls; only documents of that one range need an order
among themselves. The document on the cut gives just the words that are still missing, so each
source meets its budget to the word; budgets over the source's size repeat whole epochs first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from kindred.llm.common import boxed, col, unboxed, word_count, written
from kindred.plans.ids import number_rows

WEIGHTS = (5.0, 2.0, 1.0)
KEY_BITS = 32


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """``sizes``: source, size. Adds target: words to take of each source.

    Sources in code point order, null last, take the weights in turn; together they share all
    words by weight. Who would get more than ``most`` times its size gets just that, and the rest
    is shared again until nobody is above.
    """
    ordered = number_rows(sizes, [F.col("source").isNull(), F.col("source").asc()], "_rank", 0)
    picks = F.array(*(F.lit(float(w)) for w in weights))
    state = written(ordered.select(
        "source", "size", F.get(picks, (F.col("_rank") % len(weights)).cast("int")).alias("weight"),
        F.lit(False).alias("full"),
    ))
    while True:
        open_weight = F.coalesce(F.sum(F.when(~F.col("full"), F.col("weight"))), F.lit(0.0)).alias("weight")
        given = F.coalesce(F.sum(F.when(F.col("full"), F.col("size") * most)), F.lit(0)).alias("given")
        total = F.coalesce(F.sum("size"), F.lit(0)).alias("total")
        sums = state.agg(open_weight, given, total).first()  # three numbers
        share = F.lit(float(sums["total"] - sums["given"])) * F.col("weight") / F.lit(float(sums["weight"] or 1.0))
        target = F.when(F.col("full"), (F.col("size") * most).cast("double")).otherwise(share)
        over = ~F.col("full") & (target > F.col("size") * most)
        if not state.where(over).head(1):
            return state.select("source", "size", target.alias("target"))
        state = written(state.withColumn("full", F.col("full") | over))


def hash_key(doc_id: Column) -> Column:
    """The first 32 bits of the md5 of the id as text: even, and the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def mix_plan(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, range_rows: int = 20_000) -> DataFrame:
    """``rows``: doc_id, source, size, key. One row per source: _source, source_size, target,
    epochs (whole passes), and the place _cut (key, id, size) where the last pass ends, with the
    words _cut_words that the document there gives; _cut is null if the passes are whole."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("size"))
    targets = source_targets(sizes, weights, most)
    size = F.col("source_size")
    plan = targets.select(F.col("source").alias("_source"), F.col("size").alias("source_size"), "target").withColumn(
        "epochs", F.when(size > 0, F.least(F.floor(F.col("target") / size), F.lit(most))).otherwise(0).cast("long")
    ).withColumn("rest", F.least(F.round("target").cast("long"), size * most) - F.col("epochs") * size)

    # running sums over the key ranges of each source; a range holds about range_rows rows
    ranges = max(1, rows.count() // range_rows)
    ranged = rows.where("size > 0").withColumn("range", F.shiftright("key", KEY_BITS - (ranges - 1).bit_length()))
    per_range = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("start", F.coalesce(F.sum("words").over(upto), F.lit(0)))
    on_source = F.col("source").eqNullSafe(F.col("_source"))
    torn = starts.join(plan, on_source).where((F.col("start") < F.col("rest")) & (F.col("rest") <= F.col("start") + F.col("words")))
    torn = torn.select("_source", F.col("range").alias("_range"), (F.col("rest") - F.col("start")).alias("left"))
    # one range per source is put in order; equal rows count as one place
    inside = (
        ranged.join(torn, on_source & (F.col("range") == F.col("_range")))
        .groupBy("_source", "left", "key", "doc_id", "size").agg(F.count(F.lit(1)).alias("times"))
    )
    running = Window.partitionBy("_source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("left", F.col("left") - F.coalesce(F.sum(F.col("size") * F.col("times")).over(running), F.lit(0)))
    cuts = inside.where((F.col("left") > 0) & (F.col("left") <= F.col("size") * F.col("times"))).select(
        F.col("_source").alias("_cut_source"), F.struct("key", "doc_id", "size").alias("_cut"),
        F.floor(F.col("left") / F.col("times")).alias("_cut_words"),
    )
    return plan.join(cuts, F.col("_source").eqNullSafe(F.col("_cut_source")), "left").drop("_cut_source", "rest")


def _with_taken(rows: DataFrame, plan: DataFrame, source: Column, doc_id: Column) -> DataFrame:
    """Adds the plan's columns and _taken to rows that have _size and _key. The plan has one row
    per source; Spark broadcasts it if its size allows."""
    place = F.struct(F.col("_key").alias("key"), doc_id.alias("doc_id"), F.col("_size").alias("size"))
    extra = (
        F.when(F.col("_cut").isNull() | (F.col("_size") == 0), F.lit(0)).when(place < F.col("_cut"), F.col("_size"))
        .when(place == F.col("_cut"), F.col("_cut_words")).otherwise(F.lit(0))
    )
    joined = rows.join(plan, source.eqNullSafe(F.col("_source")))
    return joined.withColumn("_taken", F.col("epochs") * F.col("_size") + extra)


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column | None) -> DataFrame:
    words = word_count(col(text_col)) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    return written(docs.select(
        col(id_col).alias("doc_id"), col(source_col).alias("source"), words.alias("size"), hash_key(col(id_col)).alias("key"),
    ))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, range_rows: int = 20_000,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                size: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken (words taken, repeats
    counted, at most ``most`` times the size), epochs (whole passes over the source).

    ``size`` counts words unless given. Null and empty texts have the size 0 and give nothing; the
    null source is a source of its own and comes last. Rows with equal id and size share one
    place; if the cut falls on it, each gives an equal part. An empty table gives none. Other
    columns are not read.
    """
    rows = _sized(docs, id_col, text_col, source_col, size)
    plan = written(mix_plan(rows, weights, most, range_rows))
    rows = rows.withColumnsRenamed({"size": "_size", "key": "_key"})
    return _with_taken(rows, plan, F.col("source"), F.col("doc_id")).select(
        "doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"), "epochs"
    )


def take_mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = 3, range_rows: int = 20_000,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as documents, all columns kept: a row once for every time it is taken whole, and
    once more with its first words only if the cut falls on it. A cut text ends after its last
    word; what stands between the words stays. Rows of which nothing is taken go; rows without
    words cost nothing and stay, once."""
    plan = written(mix_plan(_sized(docs, id_col, text_col, source_col, None), weights, most, range_rows))
    rows = boxed(docs, id=col(id_col), text=col(text_col), source=col(source_col)).withColumns(
        {"_size": word_count(F.col("text")), "_key": hash_key(F.col("id"))}
    )
    taken = _with_taken(rows, plan, F.col("source"), F.col("id"))
    size = F.col("_size")
    wholes = F.when(size == 0, F.lit(1)).otherwise(F.floor(F.col("_taken") / size)).cast("int")
    part = F.when(size == 0, F.lit(0)).otherwise(F.col("_taken") % size).cast("int")
    copies = F.concat(
        F.array_repeat(F.lit(-1), wholes), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>"))
    )
    exploded = taken.select("row", "text", F.explode(copies).alias("words"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1)
    text = F.when(F.col("words") < 0, F.col("text")).otherwise(
        F.array_join(F.slice(pieces, 1, F.greatest(F.col("words"), F.lit(1))), "")
    )
    return unboxed(exploded, docs.columns, **{text_col: text})
