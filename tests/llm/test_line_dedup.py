import random
import time

from tests.llm.helpers import AWKWARD, documents

from kindred.llm import line_dedup


def words_apart(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, near_words=10):
    """Lines that go: those with an equal or near line before them."""
    seen, gone = [], {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        for i, line in enumerate(text.split("\n")):
            if line.strip(" \t\r\x0b\x0c"):
                words = line.strip(" \t\r\x0b\x0c").split(" ")
                same = any(w == words for w in seen)
                near = any(min(len(w), len(words)) >= near_words and words_apart(w, words) <= 1 for w in seen)
                if same or near:
                    gone[doc, i] = True
                seen.append(words)
    return set(gone)


def test_decisions_against_brute_force(spark):
    rng = random.Random(4)
    pool = [[rng.choice("abcdefgh") * rng.randrange(1, 5) for _ in range(rng.choice([1, 3, 9, 10, 11, 16, 17, 32, 33]))] for _ in range(25)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            words = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                at = rng.randrange(len(words))
                kind = rng.randrange(3)
                if kind == 0:
                    words[at] = "new" + str(rng.randrange(4))
                elif kind == 1:
                    words.insert(at, "put")
                elif len(words) > 2:
                    del words[at]
            lines.append(rng.choice(["", " ", "\t"]) + " ".join(words))
        rows.append((doc, "\n".join(lines)))
    gone = {(r.doc, r.line) for r in line_dedup.line_decisions(documents(spark, rows)).collect()}
    assert gone == brute(rows) and len(gone) > 30


def test_a_line_that_very_many_share_by_one_word(spark):
    line = "the same long template line with a place for number {} in the middle of it"
    rows = [(i, line.format(i)) for i in range(500)]
    out = line_dedup.dedup_lines(documents(spark, rows))
    kept = [r.doc_id for r in out.where("_dropped = 0").collect()]
    assert kept == [0]


def test_texts_rows_and_columns_stay(spark):
    docs = documents(spark, [*AWKWARD, (8, "short\nshort\n" + AWKWARD[5][1] + "\nlast line stands here alone")])
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_lines", "_dropped"] and out.count() == docs.count()
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert text[1] is None and text[2] == "" and text[3] == "   \n\t " and text[4] == AWKWARD[5][1]
    assert text[5] == "" and text[8] == "short\nlast line stands here alone"
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_rows_without_an_id_or_with_the_same_are_told_apart(spark):
    p, q, r = (f"line {x} of the rows that share their id" for x in "PQR")
    for one in (None, 3):
        rows = [(one, f"{p}\n{q}"), (one, f"{r}\n{p}"), (one, f"{r}\n{p}"), (one, None), (9, f"{q}\nthe only line of its kind here")]
        out = line_dedup.dedup_lines(documents(spark, rows)).collect()
        left = sorted((r.doc_id or 0, r.text or "", r._dropped) for r in out)
        # the copy of P in whichever row comes later goes, and no other line but the later Q
        first = [(one or 0, f"{p}\n{q}", 0), (one or 0, r, 1), (one or 0, r, 1)]
        last = [(one or 0, q, 1), (one or 0, f"{r}\n{p}", 0), (one or 0, f"{r}\n{p}", 0)]
        rest = [(one or 0, "", 0), (9, "the only line of its kind here", 1)]
        assert left in (sorted(first + rest), sorted(last + rest))
    # equal lines at the same place of rows that differ
    rows = [(None, f"{p}\n{x} is a line for itself alone") for x in "abc"]
    assert sorted(r._dropped for r in line_dedup.dedup_lines(documents(spark, rows)).collect()) == [0, 1, 1]


def test_texts_of_very_many_lines(spark):
    lines = [f"line number {i} of a long document" for i in range(40_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(["first", *lines, "last", "first", " last "]))]
    start = time.perf_counter()
    out = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[2].text == "first\nlast" and (out[2]._lines, out[2]._dropped) == (40_004, 40_002)
    assert time.perf_counter() - start < 60


def test_no_python_in_the_plan(spark, capsys):
    line_dedup.dedup_lines(documents(spark, AWKWARD)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Pandas" not in plan and "CartesianProduct" not in plan
