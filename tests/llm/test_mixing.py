import random

from tests.llm.helpers import AWKWARD, documents

from kindred.llm import mixing


def targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        weight = sum(w[s] for s in names if s not in full)
        out = {s: most * sizes[s] if s in full else left * w[s] / weight for s in names}
        over = {s for s in names if s not in full and out[s] > most * sizes[s]}
        if not over:
            return out
        full |= over


def sample():
    rng = random.Random(8)
    names = ["a", "B", "ä", "zz", None, "\U0001F600", "￮", "hot"]
    rows = []
    for i in range(900):
        source = "hot" if rng.random() < 0.4 else rng.choice(names)
        rows.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 60])), source))
    return rows


def test_every_source_meets_its_target(spark):
    rows = sample()
    out = mixing.mix_sources(documents(spark, rows), range_rows=50).collect()
    size, got, source = {}, {}, {r[0]: r[2] for r in rows}
    for r in out:
        size[source[r.doc_id]] = size.get(source[r.doc_id], 0) + r.size
        got[source[r.doc_id]] = got.get(source[r.doc_id], 0) + r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = targets(size)
    assert len(out) == len(rows)
    for r in out:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.source_size == size[source[r.doc_id]]
    assert all(abs(got[s] - want[s]) <= 0.5 + 1e-6 for s in want)
    # the size of the ranges, and another run, change nothing
    again = mixing.mix_sources(documents(spark, rows).repartition(7), range_rows=10**6).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}


def test_documents_of_the_mix(spark):
    rows = [(r[0], (r[1] or "").replace("w w", "w\n w "), r[2]) for r in sample()]
    docs = documents(spark, rows)
    taken = {r.doc_id: r for r in mixing.mix_sources(docs).collect()}
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns
    words, texts = {}, {r[0]: r[1] for r in rows}
    for r in out.collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert texts[r.doc_id].startswith(r.text)
    assert all(words.get(i, 0) == t.taken for i, t in taken.items())
    assert all(i in words for i, t in taken.items() if t.size == 0)


def test_awkward_rows_and_empty_table(spark):
    rows = mixing.mix_sources(documents(spark, AWKWARD)).collect()
    assert len(rows) == len(AWKWARD)
    assert sum(r.taken for r in rows) <= sum(r.size for r in rows)
    assert mixing.take_mix(documents(spark, AWKWARD)).count() >= 4
    assert mixing.mix_sources(documents(spark, AWKWARD).limit(0)).count() == 0
    empty = documents(spark, [(1, ""), (2, None)])
    assert [r.taken for r in mixing.mix_sources(empty).collect()] == [0, 0]
