"""Line dedup by deletion neighbourhoods, in DataFrame functions only.

A line, without the blanks around it, is the sequence of its words between single spaces. Two
lines are copies if they are equal, and near copies if one word edit (a word put in, taken out or
replaced) turns one into the other and the shorter has at least ``near_words`` words. Of copies and
near copies the earliest occurrence, in the order of (doc_id, hash of the text, line number), stays: a line goes if
and only if an earlier line is equal or near.

A line emits its variants with one word deleted, as hashes. Lines that are equal after the deletion
at the same place are one replacement apart; a line that equals another one's variant is one
deletion apart. So the earliest member of each key decides for all others and no pairs are made,
however many lines share a key. The edit distance is then verified on the line and the earlier
one found.

Variants are many, so lines that cannot have a partner emit none: one edit leaves the front or the
back half of a line untouched, hence only lines that share such a half with a different line are
expanded, and only in the half that may differ. This loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from kindred.llm.common import boxed, col, unboxed, written

_BLANKS = " \t\r\x0b\x0c"
# rows of the bitmap that says which lines to read again; 64 bits each, so a broadcast of 1 MB
BITMAP_ROWS = 65_536


def _cut(n: Column) -> Column:
    """Length, rounded down to an even step, that halves are taken from: n and n + 1 mostly share it."""
    step = F.greatest(F.lit(2), F.pow(F.lit(2), F.floor(F.log2(n)) - 2).cast("int"))
    return n - n % step


def _part(text: Column) -> Column:
    """What tells rows of one doc_id, or of none, apart: a hash of the text."""
    return F.xxhash64(text)


def _lines(source: DataFrame, min_chars: int) -> DataFrame:
    """doc, part, line, text of every line that takes part."""
    return (
        source.select("doc", "part", F.posexplode(
            F.transform(F.split("text", "\n", -1), lambda raw: F.btrim(raw, F.lit(_BLANKS)))
        ).alias("line", "text")).where(F.length("text") >= min_chars)
    )


def _names(text: str = "text") -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def _with_halves(lines: DataFrame, near_words: int) -> DataFrame:
    """Adds n (words) and the hashes of the front and back half to share: with lines of this cut
    length, and, where a line one word shorter has another cut length, with those."""
    n = (F.octet_length("text") - F.octet_length(F.replace(F.col("text"), F.lit(" "), F.lit(""))) + 1).cast("int")
    rows = lines.select("doc", "part", "line", "text", *_names(), n.alias("n")).select(
        "*", _cut(F.col("n")).alias("own"), _cut(F.col("n") - 1).alias("other")
    )

    def half(cut: str, side: int) -> Column:
        words = (F.col(cut) / 2).cast("int") * side
        return F.xxhash64(cut, F.lit(side), F.call_function("substring_index", F.col("text"), F.lit(" "), words))

    near = F.col("n") >= near_words
    more = (F.col("n") > near_words) & (F.col("own") != F.col("other"))
    return rows.select(
        "doc", "part", "line", "h1", "h2", "n", F.when(near, half("own", 1)).alias("front"), F.when(near, half("own", -1)).alias("back"),
        F.when(more, half("other", 1)).alias("front2"), F.when(more, half("other", -1)).alias("back2"),
    )


def line_decisions(docs: DataFrame, min_chars: int = 1, near_words: int = 10,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines that go: doc, part (_part of the row's text), line (number from 0), near (whether only
    a near copy is earlier)."""
    source = docs.select(col(id_col).alias("doc"), _part(col(text_col)).alias("part"), col(text_col).alias("text"))
    table = written(_with_halves(_lines(source, min_chars), near_words))
    halves = ["front", "back", "front2", "back2"]
    # the earliest occurrence of every distinct line
    first = table.groupBy("h1", "h2", "n", *halves).agg(F.min(F.struct("doc", "part", "line")).alias("pos"))

    # lines that share a half with a different line; sides 0 and 2 are fronts
    sided = first.where(F.col("n") >= near_words).select(
        "h1", "h2", "n", "pos", F.posexplode(F.array(*halves)).alias("side", "half")
    ).where("half is not null")
    shared = sided.groupBy("half").agg(
        F.min("h1").alias("lo"), F.max("h1").alias("hi"), (F.min("n") != F.max("n")).alias("mixed")
    ).where("lo <> hi").select("half", "mixed")
    open_lines = written(
        sided.join(shared, "half").groupBy("h1", "h2", "pos").agg(
            F.max(F.col("side") % 2 == 0).alias("front"), F.max(F.col("side") % 2 == 1).alias("back"), F.max("mixed").alias("mixed"),
        )
    )

    # their words are read again, at their first occurrence; a bitmap of fixed size keeps most other
    # lines out of the shuffle (those it lets through by chance find no partner in the join)
    row, bit = F.pmod("h1", F.lit(BITMAP_ROWS)).cast("int"), F.pmod(F.shiftright("h1", 32), F.lit(64)).cast("int")
    single = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    bitmap = open_lines.groupBy(row.alias("row")).agg(F.bit_or(single).alias("bits"))
    candidates = _lines(source, min_chars).select("doc", "part", "line", "text", *_names()).withColumn("row", row)
    candidates = candidates.join(F.broadcast(bitmap), "row").where(F.col("bits").bitwiseAND(single) != 0)
    words = F.transform(F.split("text", " ", -1), lambda w: F.xxhash64(w))
    lines = written(
        candidates.select(F.struct("doc", "part", "line").alias("pos"), "h1", "h2", "text")
        .join(open_lines, ["h1", "h2", "pos"]).select("h1", "pos", "front", "back", "mixed", words.alias("words"))
        .dropDuplicates(["h1"])
    )

    # the half that is shared holds no edit
    n = F.size("words")
    safe = F.when(n > near_words, (_cut(n - 1) / 2).cast("int")).otherwise((_cut(n) / 2).cast("int"))
    begin = F.when(F.col("back"), F.lit(0)).otherwise(safe)
    end = F.when(F.col("front"), n - 1).otherwise(n - 1 - safe)
    variants = lines.select(
        "h1", "mixed", n.alias("n"), begin.alias("begin"),
        F.posexplode(F.transform(
            F.sequence(begin, end), lambda i: F.xxhash64(F.concat(F.slice("words", F.lit(1), i), F.slice("words", i + 2, n)))
        )).alias("at", "rest"),
    )
    # one replacement: equal rests after the deletion at the same place
    placed = variants.select("h1", F.xxhash64("rest", F.col("at") + F.col("begin"), "n").alias("key"))
    met = placed.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key")
    at_once = lines.select("h1", "pos")
    members = placed.join(met, "key").join(at_once, "h1")
    earliest = members.groupBy("key").agg(F.min(F.struct("pos", "h1")).alias("early"))
    replaced = members.join(earliest, "key").where("early.pos < pos").select("h1", "early")
    # one deletion: a rest equals a shorter line
    shorter = lines.where(F.col("mixed") & (n >= near_words)).select(
        F.xxhash64("words").alias("rest"), F.struct("pos", "h1").alias("short")
    )
    dropped = variants.where(F.col("mixed") & (F.col("n") > near_words)).select("h1", "rest").join(shorter, "rest")
    dropped = dropped.join(at_once, "h1").select(F.struct("pos", "h1").alias("long"), "short")
    taken = dropped.select(F.greatest("short", "long").getField("h1").alias("h1"), F.least("short", "long").alias("early"))
    # the earliest partner of each line, verified on the words
    partner = replaced.unionByName(taken).groupBy("h1").agg(F.min("early").alias("early"))
    near = (
        partner.join(lines.select("h1", F.col("words").alias("mine")), "h1")
        .join(lines.select(F.col("h1").alias("_early"), F.col("words").alias("theirs")), F.col("early.h1") == F.col("_early"))
        .where(one_word_apart(F.col("mine"), F.col("theirs")))
        .select("h1", F.lit(True).alias("near"))
    )
    verdicts = first.select("h1", "h2", "pos").join(near, "h1", "left")
    later = F.struct("doc", "part", "line") > F.col("pos")
    return (
        table.select("doc", "part", "line", "h1", "h2").join(verdicts, ["h1", "h2"])
        .where(F.col("near") | later).select("doc", "part", "line", (~later).alias("near"))
    )


def one_word_apart(a: Column, b: Column) -> Column:
    """Whether one word edit at most turns word list ``a`` into ``b``.

    The words both share at the front, plus those they share at the back, reach to at most one
    word of the longer list.
    """
    short = F.least(F.size(a), F.size(b))
    front = F.aggregate(
        F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, e: F.struct((s["n"] + (s["on"] & e).cast("int")).alias("n"), (s["on"] & e).alias("on")),
        lambda s: s["n"],
    )
    rest = short - front
    gap = F.abs(F.size(a) - F.size(b))
    # after the front one word may differ; the rest must be equal
    skip_a = F.when(F.size(a) >= F.size(b), front + 2).otherwise(front + 1)
    skip_b = F.when(F.size(b) >= F.size(a), front + 2).otherwise(front + 1)
    return (gap <= 1) & (
        ((rest == 0) & (gap <= 1)) | (F.slice(a, skip_a, F.size(a) + 2) == F.slice(b, skip_b, F.size(b) + 2))
    )


def dedup_lines(docs: DataFrame, min_chars: int = 1, near_words: int = 10,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with the lines that go taken out of the text, plus _lines (lines of
    the text) and _dropped (how many of them went).

    Lines under ``min_chars`` characters, blanks around them not counted, never go: by default only those
    without any. Shorter lines than ``near_words`` words go for equal ones only.
    Null and empty texts stay as they are; every row stays, even if no line is left. A row
    is known by its doc_id and a hash of its text: lines of rows that are equal in both are the same
    occurrence, so repeated rows stay equal; rows that share a doc_id, or have none, but differ in
    text are documents of their own, in the order of that hash. A null doc_id comes first.
    An empty table gives an empty table.
    """
    gone = line_decisions(docs, min_chars, near_words, id_col, text_col)
    # one bit per line, 64 to a number, so that a look at a line costs the same in a text of any length
    shift = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("line") % 64)
    gone = gone.groupBy("doc", "part", F.shiftright("line", 6).alias("at")).agg(F.bit_or(shift).alias("bits"))
    gone = gone.groupBy("doc", "part").agg(
        F.collect_list(F.struct("at", "bits")).alias("some"), F.max("at").alias("last"),
        F.sum(F.bit_count("bits")).alias("n_gone"),
    )
    every = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(
        F.get(F.filter("some", lambda s: s["at"] == i), F.lit(0))["bits"], F.lit(0).cast("long")
    ))
    gone = gone.select("doc", "part", every.alias("gone"), "n_gone")
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("own_part") == F.col("part"))
    joined = boxed(docs, id=col(id_col), own_part=_part(col(text_col)), text=col(text_col)).join(gone, same, "left")
    lines = F.split("text", "\n", -1)
    has = F.col("gone").isNotNull() & F.col("text").isNotNull()
    kept = F.filter(lines, lambda x, i: F.call_function(
        "getbit", F.coalesce(F.get("gone", F.shiftright(i, 6)), F.lit(0).cast("long")), i.bitwiseAND(F.lit(63))
    ) == 0)
    total = F.coalesce(F.regexp_count("text", F.lit("\n")) + 1, F.lit(0)).cast("long")
    dropped = F.when(has, F.col("n_gone")).otherwise(F.lit(0)).cast("long")
    text = F.when(has, F.array_join(kept, "\n")).otherwise(F.col("text"))
    columns = [c for c in docs.columns if c not in ("_lines", "_dropped")]
    return unboxed(joined, [*columns, "_lines", "_dropped"], **{text_col: text, "_lines": total, "_dropped": dropped})
