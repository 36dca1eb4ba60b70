import hashlib
from collections import defaultdict

import __spark_entry__ as driver
import corpus_pipeline
from tests.llm.test_mixing import targets
from tests.llm.test_simhash import components, plain_print

from kindred.llm import packing, toxicity
from kindred.llm.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = set(driver.queries())
    assert {"pipeline", *QUERIES} <= names and set(ORACLES) <= set(QUERIES)
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_stages_keep_the_columns_and_do_their_work(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name in ("toxicity", "simhash"):
            assert 0.8 * before.count() < docs.count() <= before.count()
            kept = {r.doc_id: r.text for r in before.collect()}
            assert all(kept[r.doc_id] == r.text for r in docs.collect())
    assert docs.count() > 0 and rows > 0
    whole = corpus_pipeline.run(spark, SMALL)
    pick = ["doc_id", "piece", "start", "n_words"]
    assert sorted(map(tuple, whole.select(pick).collect())) == sorted(map(tuple, docs.select(pick).collect()))


def one_edit(a, b):
    """At most one word put in, taken out or replaced."""
    front = 0
    while front < min(len(a), len(b)) and a[front] == b[front]:
        front += 1
    back = 0
    while back < min(len(a), len(b)) - front and a[-1 - back] == b[-1 - back]:
        back += 1
    return max(len(a), len(b)) - front - back <= 1


def without_repeated_lines(docs):
    seen, out = defaultdict(list), {}
    for doc in sorted(docs):
        text, source = docs[doc]
        kept = []
        for line in (text or "").split("\n"):
            words = line.strip(" \t\r\x0b\x0c").split(" ")
            n = len(words)
            if words != [""]:
                earlier = [w for m in (n - 1, n, n + 1) for w in seen[m]]
                gone = any(w == words or min(len(w), n) >= 10 and one_edit(w, words) for w in earlier)
                seen[n].append(words)
                if gone:
                    continue
            kept.append(line)
        out[doc] = (None if text is None else "\n".join(kept), source)
    return out


def mixed(docs):
    """(doc_id, words) for every copy that the mix takes."""
    size = {d: len((t or "").encode().split()) for d, (t, _) in docs.items()}
    per_source = defaultdict(int)
    for d, (_, source) in docs.items():
        per_source[source] += size[d]
    want, out = targets(per_source), []
    for source, total in per_source.items():
        epochs = min(3, int(want[source] // total)) if total else 0
        left = round(want[source]) - epochs * total
        mine = [d for d in docs if docs[d][1] == source]
        for d in sorted(mine, key=lambda d: (hashlib.md5(str(d).encode()).hexdigest()[:8], d)):
            part = max(0, min(left, size[d]))
            left -= size[d]
            full = epochs + (part == size[d] and size[d] > 0)
            out += [(d, size[d])] * (full if size[d] else 1)
            if 0 < part < size[d]:
                out.append((d, part))
    return out


def test_the_whole_pipeline_against_brute_force(spark):
    table, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train_on_rest(table, labels)
    docs = {r.doc_id: (r.text, r.source) for r in table.collect()}
    docs = {d: row for d, row in docs.items() if model.score(model.evidence(row[0])) < 0.3}
    docs = without_repeated_lines(docs)
    ids = sorted(docs)
    group = components([plain_print(docs[d][0]) for d in ids], 4)
    docs = {d: docs[d] for i, d in enumerate(ids) if group[i] == i}
    longest = max(packing.LENGTHS)
    want = [
        (d, k, k * longest, min(longest, words - k * longest))
        for d, words in mixed(docs) for k in range(max(1, -(-words // longest)))
    ]
    got = corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "start", "n_words").collect()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 100
