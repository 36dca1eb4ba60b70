"""Best-fit packing into bins of several permitted lengths.

A text longer than the longest length is cut into full pieces and a rest; full pieces are bins of
their own. The rests are dealt out by hash and packed chunk by chunk, longest first: a piece goes
into the open bin that it leaves the least room in; if none has room, a bin is opened whose size
costs least for each word it is expected to hold (its room can only be filled by what is still
to come and short enough). In the end each bin shrinks to the shortest length that holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from kindred.llm.common import col, word_count, written

LENGTHS = (256, 512, 1024, 2048)
BIN_COST = 8  # what opening a bin costs, in words: start and end marks, a row of its own
SCHEMA = (
    "doc_id {id}, piece long, start long, n_words long, bin_id long, bin_length long, bin_words long, bin_offset long"
)


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, bin_cost: float = BIN_COST):
    """Pack sizes (1 to the longest length, in descending order) into bins.

    Returns the bin of each size and its offset there, and per bin its length and its words.
    """
    lengths = tuple(sorted(lengths))
    todo = [0] * (lengths[-1] + 1)  # words still to come, by size
    for s in sizes:
        todo[s] += s
    below = [0] * (lengths[-1] + 1)
    for s in range(1, lengths[-1] + 1):
        below[s] = below[s - 1] + todo[s]
    rooms: dict[int, list[int]] = {}  # free words -> open bins
    mask = 0  # bit r is set if a bin with r free words is open
    capacity: list[int] = []
    used: list[int] = []
    where: list[tuple[int, int]] = []
    last, done = 0, 0
    for s in sizes:
        if s != last:
            last, done = s, 0
        fitting = mask >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            # what may still come: all shorter sizes, and the rest of this one
            def price(c: int) -> tuple[float, int]:
                gap = min(c - s, s)
                coming = below[gap] - (done + s if gap == s else 0)
                return (c + bin_cost) / (s + max(0, min(c - s, coming))), c

            size = min((c for c in lengths if c >= s), key=price)
            b = len(capacity)
            capacity.append(size)
            used.append(0)
        where.append((b, used[b]))
        used[b] += s
        done += s
        free = capacity[b] - used[b]
        if free:
            rooms.setdefault(free, []).append(b)
            mask |= 1 << free
    shrunk = [next(c for c in lengths if c >= u) for u in used]
    return where, shrunk, used


def pack_documents(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, bin_cost: float = BIN_COST,
                   chunk_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row of ``docs``: doc_id, piece (from 0), start (first word in the
    text), n_words, bin_id, bin_length (a permitted length), bin_words (words in the bin),
    bin_offset (of the piece in its bin).

    Ids keep their own type, number or text. Null and empty texts are one piece of no words without a bin. Repeated rows are packed each.
    An empty table gives none. Other columns are not read. Bins never hold pieces of two chunks;
    a chunk has ``chunk_rows`` pieces, whatever the size of the table.
    """
    longest = max(lengths)
    sized = written(docs.select(
        col(id_col).alias("doc_id"), word_count(col(text_col)).alias("size"),
        F.xxhash64(col(id_col), col(text_col)).alias("deal"),
    ))
    full, rest = F.floor(F.col("size") / longest), F.col("size") % longest
    none = F.lit(None).cast("long")
    # a full piece is a bin; its id has a namespace of its own, made from the hash and the place
    wholes = sized.where(F.col("size") >= longest).select(
        "doc_id", "deal", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece")
    ).select(
        "doc_id", "piece", (F.col("piece") * longest).alias("start"), F.lit(longest).cast("long").alias("n_words"),
        F.lit(True).alias("whole"), "deal",
    )
    empty = sized.where("size = 0").select(
        "doc_id", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_words"),
        none.alias("bin_id"), none.alias("bin_length"), none.alias("bin_words"), none.alias("bin_offset"),
    )
    rests = sized.where(rest > 0).select(
        "doc_id", full.alias("piece"), (full * longest).alias("start"), rest.alias("n_words"), F.lit(False).alias("whole"), "deal",
    )
    chunks = max(1, sized.where(rest > 0).count() // chunk_rows)

    schema = SCHEMA.format(id=sized.schema["doc_id"].dataType.simpleString())
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 40
        serial = 0

        def result(rows: pa.Table, bins: list) -> list[pa.RecordBatch]:
            made = [pa.array(b, pa.int64()) for b in bins]
            same = [rows.column(name) for name in ("doc_id", "piece", "start", "n_words")]
            return pa.Table.from_arrays([*same, *made], names).combine_chunks().to_batches()

        def packed(rows: pa.Table) -> list[pa.RecordBatch]:
            nonlocal serial
            # longest first; rows come in the order of deal, piece and doc_id, which settles ties
            rows = rows.take(np.argsort(-rows.column("n_words").to_numpy(), kind="stable"))
            where, shrunk, used = pack(rows.column("n_words").to_pylist(), lengths, bin_cost)
            first, serial = task + serial, serial + len(shrunk)
            return result(rows, [
                [first + b for b, _ in where], [shrunk[b] for b, _ in where], [used[b] for b, _ in where], [o for _, o in where],
            ])

        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            table = pa.Table.from_batches([batch])
            whole = table.filter(table.column("whole"))
            n = len(whole)
            if n:
                yield from result(whole, [range(task + serial, task + serial + n), [longest] * n, [longest] * n, [0] * n])
                serial += n
            part = table.filter(pc.invert(table.column("whole")))
            while len(part):
                take = part.slice(0, chunk_rows - count)
                held.append(take)
                count += len(take)
                part = part.slice(len(take))
                if count == chunk_rows:
                    yield from packed(pa.concat_tables(held))
                    held, count = [], 0
        if held:
            yield from packed(pa.concat_tables(held))

    dealt = wholes.unionByName(rests).repartition(chunks, "deal", "piece").sortWithinPartitions("deal", "piece", "doc_id")
    return dealt.mapInArrow(run, schema).unionByName(empty)
