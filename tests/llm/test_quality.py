import math
import random

import numpy as np
from helpers import AWKWARD, documents

from entitynet.llm import quality
from entitynet.llm.queries import QUERIES
from entitynet.llm.tables import read

LABELS = "doc_id bigint, quality int, toxic int"


def labelled(spark, n=300):
    """Prose, and three kinds of spoilt prose, a quarter of the texts."""
    r = random.Random(6)
    rows, marks = [], []
    for i in range(n):
        words = [r.choice(["lo", "rem", "ipsum", "dolor", "sit", "amet,", "ad.", "Quis"]) + r.choice("abcdefgh") for _ in range(r.randrange(10, 150))]
        spoil = r.randrange(3) if i % 4 == 0 else None
        words = words[:1] * len(words) if spoil == 0 else [w.upper() + "!!" for w in words] if spoil == 1 else [w + "###" for w in words] if spoil == 2 else words
        rows.append((i, " ".join(words)))
        marks.append((i, int(spoil is None), 0))
    return documents(spark, rows), spark.createDataFrame(marks, LABELS)


def test_spoilt_texts_that_taught_nothing_are_found(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    aside = [i for i, r in got.items() if r.held_out]
    assert len(got) == 300 and len(aside) > 40 and all(got[i].predicted == truth[i] == (got[i].score >= 0.3) for i in aside)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = labelled(spark, 120)
    turned = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    assert sorted(quality.judged(docs, labels).collect()) == sorted(quality.judged(docs, turned).collect())


def test_score_is_the_sum_of_looked_up_numbers(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(800, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, np.arange(800) % 5 == 0)
    assert (0, 1) in model.pairs and ((model.score(x) > 0.5) == (y == 1)).mean() > 0.97

    def plain(row):
        at = [sum(v >= c for c in cuts) for v, cuts in zip(row, model.cuts)]
        total = model.intercept + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
        return 1 / (1 + math.exp(-total))

    assert np.allclose([plain(row) for row in x[:50]], model.score(x[:50]), rtol=1e-12)


def test_trees_meet_brute_force():
    r = np.random.default_rng(2)
    g, h = r.normal(size=7), r.random(7)
    leaf = lambda s: g[s].sum() ** 2 / (h[s].sum() + quality.RIDGE)
    first = max(range(1, 7), key=lambda k: leaf(slice(0, k)) + leaf(slice(k, 7)))
    grown = quality.tree(g, h)
    assert len(set(grown)) <= 3 and grown[first - 1] != grown[first]
    g, h = r.normal(size=(4, 5)), r.random((4, 5))
    parts = lambda a, i, j: [a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]]
    gain = lambda i, j: sum(x.sum() ** 2 / (w.sum() + quality.RIDGE) for x, w in zip(parts(g, i, j), parts(h, i, j)))
    best = max((gain(i, j) - g.sum() ** 2 / (h.sum() + quality.RIDGE), i, j) for i in range(1, 4) for j in range(1, 5))
    found, out = quality.quadrants(g, h)
    assert np.isclose(found, best[0])
    for x, a, w in zip(parts(out, *best[1:]), parts(g, *best[1:]), parts(h, *best[1:])):
        assert np.allclose(x, a.sum() / (w.sum() + quality.RIDGE))


def test_features_meet_plain_python():
    for text in ("Ab cd. AB!! 12 ##\n\nab cd cd É\nab cd cd É", "x", "| a |"):
        got, words = dict(zip(quality.FEATURES, quality.features(text.encode()))), text.split()
        size, lines = len(text.encode()), [x for x in text.split("\n") if x.strip()]
        assert np.isclose(got["words"], math.log1p(len(words))) and np.isclose(got["word_length"], np.mean([len(w.encode()) for w in words]))
        assert np.isclose(got["symbols"], sum(c in "!#|" for c in text) / size) and np.isclose(got["digits"], sum(c.isdigit() for c in text) / size)
        assert np.isclose(got["symbol_ends"], np.mean([w[-1] in "!#|" for w in words])) and np.isclose(got["symbol_words"], np.mean([not any(c.isalnum() for c in w) for w in words]))
        assert np.isclose(got["repeated_lines"], 1 - len(set(lines)) / len(lines)) and np.isclose(got["stutter"], sum(a == b for a, b in zip(words, words[1:])) / len(words))
        assert np.isclose(got["upper_words"], np.mean([sum(c.isascii() and c.isupper() for c in w) == len([b for b in w.encode() if b > 127 or chr(b).isalpha()]) > 1 for w in words]))


def test_awkward_rows_missing_labels_and_clashing_columns(spark):
    pairs = [(None if i == 2 else i // 2, t) for i, t in enumerate(AWKWARD)]
    docs = documents(spark, pairs).selectExpr("*", "1 AS score", "2 AS x", "3 AS hash", "4 AS _row", "5 AS held_out")
    rows = quality.scored(docs, quality.Model()).collect()
    assert len(rows) == len(pairs) and rows[0]["x"] == 2 and {r.score for r in rows} == {0.5}
    _, labels = labelled(spark, 60)
    empty, odd = labels.limit(0), spark.createDataFrame([(None, 1, 0), (1, None, 0), (2, 7, 0)], LABELS)
    assert {r.score for r in quality.judged(docs, empty).collect()} == {0.5} == {r.score for r in quality.judged(docs, odd).collect()}
    one = spark.createDataFrame([(i, 1, 0) for i in range(6)], LABELS)
    assert len({r.score for r in quality.judged(docs, one).collect()}) == 1
    taught, labels = labelled(spark, 80)
    both = quality.judged(documents(spark, pairs), labels.unionByName(labels))
    assert both.count() == len(pairs) and quality.judged(docs.limit(0), labels).count() == 0
    got = quality.judged(taught.unionByName(documents(spark, [(None, t) for t in AWKWARD])), labels).collect()
    assert all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id is None}) > 1


def test_registered_query_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op11_additive_quality"](spark, sf).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows) and all(r.predicted for r in rows if r.quality)
