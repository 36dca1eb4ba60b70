import random

import pytest
from tests.llm.helpers import AWKWARD, documents

from kindred.llm import toxicity


@pytest.fixture(scope="module")
def model():
    return toxicity.Toxicity({"idiot$": 1.0, "blöd": 0.8})


def test_clauses_weigh_what_stands_around_the_word(model):
    e = model.evidence
    plain = e("an idiot walks by")
    assert plain == 1.0
    assert e("you idiot") > plain > e("not an idiot") > 0
    assert e("it was said an idiot walks") == 0.5 and e('"idiot"') == 0.5
    assert e("you. idiot") == plain  # another clause
    assert e("Blöder Kerl") == 0.8 and e("idiotic talk") == 0  # whole word against beginning
    assert e("I will kill you") == toxicity.THREAT_WEIGHT
    assert e("I will not kill you") < toxicity.THREAT_WEIGHT and e("kill the lights") == 0
    assert e(None) == e("") == e("   ") == 0


def test_composition_equals_the_parts_run_side_by_side():
    parts = (toxicity.insult(), toxicity.threat(), toxicity.window(toxicity.TARGET, 4, 1.5),
             toxicity.window(toxicity.NEGATION, 3, 0.3), toxicity.reported(0.5))
    grammar, rng = toxicity.Grammar(), random.Random(2)
    for _ in range(300):
        tags = [(rng.randrange(8), 1.0) for _ in range(rng.randrange(20))]
        states, want = [0] * 5, 0.0
        for tag, weight in tags:
            factor = 1.0
            for p, s in list(zip(parts, states))[2:]:
                factor *= p.factor[s]
            states = [p.step(s, tag) for p, s in zip(parts, states)]
            want += factor * weight if states[0] == 1 else factor * toxicity.THREAT_WEIGHT if states[1] == 7 else 0
        assert grammar.clause(tags) == pytest.approx(want)


def made(n=600):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeft") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 80))]
        toxic = rng.random() < 0.2
        for _ in range(3 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(["grobian", "schurk" + rng.choice(["e", "en", "isch"])]))
        docs.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learns_words_and_beginnings_and_holds_out(spark):
    docs, labels = made()
    table = spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(documents(spark, docs), table).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert 80 < len(held) < 220
    right = sum(r.predicted == truth[r.doc_id] for r in held) / len(held)
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)
    # held-out labels play no part
    flipped = table.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - toxic else toxic end as toxic")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(documents(spark, docs), flipped).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_awkward_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([(4, 1), (4, None), (5, 0), (None, 1)], "doc_id long, toxic int")
    docs = documents(spark, AWKWARD)
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == len(AWKWARD) and not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.score_toxicity(docs, labels.limit(0)).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).columns == docs.columns


def test_an_id_on_very_many_texts_counts_once(spark):
    docs, labels = made()
    flooded = documents(spark, docs).unionByName(documents(spark, [(docs[0][0], f"flood {i} of rows") for i in range(5_000)]))
    table = spark.createDataFrame([*labels, (labels[0][0], 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_texts(flooded, table, 20, "doc_id", "text", "toxic")
    assert rows.count() <= 40 and rows.select("id").distinct().count() == rows.count()
    whole = toxicity.labelled_texts(flooded, table, 10_000, "doc_id", "text", "toxic")
    assert whole.where(f"id = {docs[0][0]}").count() == 1 and whole.count() == len(docs)
    strings = toxicity.score_toxicity(flooded.limit(50).selectExpr("cast(doc_id as string) doc_id", "text"), table.selectExpr("cast(doc_id as string) doc_id", "toxic"))
    assert strings.count() == 50


def test_copies_of_a_toxic_text_teach_no_words():
    text = " ".join(f"w{i}" for i in range(60))
    import pandas as pd

    rows = pd.DataFrame({"id": range(30), "keys": [toxicity.family_keys(text + f" end{i}") for i in range(30)]})
    assert len(toxicity.one_per_family(rows)) <= 2
