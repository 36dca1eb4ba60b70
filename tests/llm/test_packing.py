import random

from tests.llm.helpers import AWKWARD, documents

from kindred.llm import packing


def plain_pack(sizes, lengths, bin_cost):
    """The definition, with a search over all open bins for every piece."""
    capacity, used = [], []
    for k, s in enumerate(sizes):
        fitting = [(capacity[b] - used[b] - s, b) for b in range(len(used)) if capacity[b] - used[b] >= s]
        if fitting:
            tightest = min(fitting)[0]
            choice = [b for room, b in fitting if room == tightest]
        else:
            prices = []
            for c in lengths:
                if c >= s:
                    gap = c - s
                    coming = sum(t for t in sizes[k + 1:] if t <= gap)
                    prices.append(((c + bin_cost) / (s + min(gap, coming)), c))
            capacity.append(min(prices)[1])
            used.append(0)
            choice = [len(used) - 1]
        yield s, choice, used


def test_best_fit_step_by_step():
    """Each piece goes where a plain search over all open bins puts it; among bins with equal room
    any will do, as they take the same pieces from then on."""
    rng = random.Random(1)
    lengths = (16, 32, 64)
    for _ in range(60):
        sizes = sorted((rng.choice([rng.randrange(1, 65), rng.randrange(1, 9)]) for _ in range(rng.randrange(80))), reverse=True)
        where, shrunk, used = packing.pack(sizes, lengths, 4)
        assert len(where) == len(sizes)
        opened = 0
        for (s, choice, filled), (b, at) in zip(plain_pack(sizes, lengths, 4), where):
            assert b in choice and at == filled[b]
            opened = max(opened, b + 1)
            assert opened == len(filled)
            filled[b] += s
        assert opened == len(used) and (not sizes or filled == used)
        for u, length in zip(used, shrunk):
            assert u <= length and all(c < u for c in lengths if c < length)


def test_a_piece_takes_the_tightest_open_bin():
    # bins of 64 with 60 and 50 in them; 4 fits both and goes to the fuller one
    where, _, _ = packing.pack([60, 50, 4], (64,), 4)
    assert where == [(0, 0), (1, 0), (0, 60)]


def test_bin_size_follows_what_is_still_to_come():
    assert packing.pack([10], (16, 64), 4)[1] == [16]
    where, shrunk, _ = packing.pack([10] * 6, (16, 64), 4)
    assert shrunk == [64] and {b for b, _ in where} == {0}


def check(rows, texts, lengths):
    words = {}
    bins = {}
    for r in rows:
        words.setdefault(r.doc_id, []).append((r.piece, r.start, r.n_words))
        if r.n_words:
            bins.setdefault(r.bin_id, []).append(r)
    for i, text in texts.items():
        at = 0
        for k, (piece, start, n) in enumerate(sorted(words[i])):
            assert (piece, start) == (k, at)
            at += n
        assert at == len((text or "").split())
    for rows_ in bins.values():
        at = 0
        for r in sorted(rows_, key=lambda r: r.bin_offset):
            assert r.bin_offset == at
            at += r.n_words
        assert {(r.bin_words, r.bin_length) for r in rows_} == {(at, min(c for c in lengths if c >= at))}
    return bins


def test_pieces_cover_texts_and_bins_hold_them(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.choice([0, 3, 40, 256, 700, 2048, 5000]))) for i in range(150)]
    docs = documents(spark, rows)
    for chunk in (20_000, 40):
        bins = check(packing.pack_documents(docs, chunk_rows=chunk).collect(), dict(rows), packing.LENGTHS)
    filled = sum(r.n_words for b in bins.values() for r in b) / sum(b[0].bin_length for b in bins.values())
    assert filled > 0.9


def test_awkward_rows_and_empty_table(spark):
    rows = packing.pack_documents(documents(spark, AWKWARD)).collect()
    assert sum(r.n_words for r in rows) == sum(len((t or "").split()) for _, t in AWKWARD)
    assert [r.bin_id for r in rows if r.n_words == 0] == [None] * 4
    assert packing.pack_documents(documents(spark, AWKWARD).limit(0)).count() == 0


def test_ids_keep_their_type(spark):
    big = 2**53 + 1  # no double holds it
    rows = packing.pack_documents(documents(spark, [(big, "one two three"), (None, "four five"), (1, "")])).collect()
    assert {r.doc_id: r.n_words for r in rows} == {big: 3, None: 2, 1: 0}
    named = spark.createDataFrame([("doc-a", "w " * 5000), ("doc-b", "w"), (None, "w w")], "doc_id string, text string")
    out = packing.pack_documents(named)
    assert out.schema["doc_id"].dataType.simpleString() == "string"
    check(out.collect(), {"doc-a": "w " * 5000, "doc-b": "w", None: "w w"}, packing.LENGTHS)
