import random

import numpy as np
import pytest
from helpers import AWKWARD, documents

from entitynet.llm import toxicity
from entitynet.llm.tables import held_out
from pyspark.sql import functions as F


def test_folding():
    assert toxicity.folded("1D10T id!ot! ІDІОТ ｉｄｉｏｔ id​iot $cum") == ["idiot", "idiot", "idiot", "idiot", "idiot", "scum"]


def test_exceptions_and_beginnings():
    model = toxicity.Model({" trash ": 2.0, " moro": 1.0})
    machine = model.automaton()
    total = lambda t: sum(w for *_, w in toxicity.found(machine, toxicity.folded(t)))
    assert [total(t) for t in ("trash", "the trash can", "trash trash can", "moronic", "a moro", "trashy", "amoro", "")] == [2, 0, 2, 1, 1, 0, 0, 0]


@pytest.fixture(scope="module")
def corpus(spark):
    r = random.Random(5)
    plain = [f"w{''.join(r.choice('abcdefg') for _ in range(3))}" for _ in range(300)]
    rows = []
    for i in range(400):
        words = [r.choice(plain) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for w in r.sample(["zonk", "blarg", "stemmyx", "stemmyq", "stemmyz"], 2):
                words.insert(r.randrange(40), w)
        if i % 5 == 1 and not toxic:
            words += ["blarg", "monkey"]
        rows.append((i, " ".join(words), int(toxic)))
    docs = documents(spark, [(i, t) for i, t, _ in rows])
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")


def test_learns_entries_and_held_out_labels(spark, corpus):
    docs, labels = corpus
    got = toxicity.scored(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    test = got[got.held_out]
    assert len(test) > 50 and (test.predicted == test.toxic).mean() > 0.95 and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_held_out_labels_are_never_read(spark, corpus):
    docs, labels = corpus
    turned = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.scored(docs, labels).orderBy("doc_id").collect() == toxicity.scored(docs, turned).orderBy("doc_id").collect()


def test_awkward_texts_and_tables(spark, corpus):
    docs, labels = corpus
    more = docs.unionByName(documents(spark, [(1000 + i, t) for i, t in enumerate(AWKWARD)])).unionByName(documents(spark, [(None, "blarg")]))
    rows = toxicity.scored(more, labels).collect()
    assert len(rows) == 400 + len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == 0 for r in rows if r.doc_id in (1000, 1001, 1002))
    assert toxicity.scored(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.scored(docs.limit(5), labels.limit(0)).collect()} == {0.0}


def test_nested_entries_keep_the_longest_that_covers():
    found = {" loser ": (5.0, 100), " lose": (4.0, 104), " stem": (5.0, 300), " stemx": (5.2, 40), " stema ": (7.0, 30)}
    assert toxicity.distinct_entries(found) == {" loser ": 5.0, " stem": 5.0, " stema ": 7.0}


def test_curve_separates():
    data = np.array([(0, 0, 0)] * 20 + [(1, 2, 1)] * 20, float)
    a, b, c = toxicity.curve(data)
    assert a < 0 < a + b + 2 * c


def test_matches_meet_a_naive_scan():
    r = random.Random(7)
    for _ in range(60):
        words = [r.choice(["bad", "badly", "egg", "good", "eggs", "x"]) for _ in range(r.randrange(30))]
        model = toxicity.Model({" bad": 1.5, " egg ": 2.0, " badly ": 0.5}, ("good egg", "bad egg x", "egg x badly"))
        joined = f" {' '.join(words)} "
        spans = lambda entry: [(i, i + len(entry) - 1) for i in range(len(joined)) if joined.startswith(entry, i)]
        spared = [s for p in model.exceptions for s in spans(f" {p} ")]
        want = [(a, b, w) for e, w in model.entries.items() for a, b in spans(e) if not any(c <= a and b <= d for c, d in spared)]
        assert sorted(toxicity.found(model.automaton(), words)) == sorted(want if words else [])
