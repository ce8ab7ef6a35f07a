from itertools import product

import numpy as np
from helpers import AWKWARD, documents
from pyspark.sql import functions as F

from entitynet.llm import langid

EN = ["the cat and the dog sleep in the house", "she was walking with her friends", "this is what they think about it"]
DE = ["der hund und die katze schlafen im haus", "sie ging mit ihren freunden spazieren", "das ist was sie darüber denken"]


def model():
    texts = [t for t in EN + DE for _ in range(3)]
    return langid.fit(texts, ["en"] * 9 + ["de"] * 9)


def test_forward_backward_matches_enumeration():
    r = np.random.default_rng(0)
    m = langid.Model(["a", "b", "c"], {}, None, None, r.normal(size=(3, 3)), r.normal(size=3))
    scores, start, length = r.normal(size=(7, 3)), np.array([0, 4, 5]), np.array([4, 1, 2])
    both, moves = langid.forward_backward(scores, m, start, length)
    want, want_moves = np.zeros((7, 3)), np.zeros((3, 3))
    for s, n in zip(start, length):
        weights, total = {}, 0
        for path in product(range(3), repeat=n):
            w = np.exp(m.starts[path[0]] + sum(scores[s + i, p] for i, p in enumerate(path)) + sum(m.moves[a, b] for a, b in zip(path, path[1:])))
            weights[path], total = w, total + w
        for path, w in weights.items():
            for i, p in enumerate(path):
                want[s + i, p] += w / total
            for a, b in zip(path, path[1:]):
                want_moves[a, b] += w / total
    assert np.allclose(both, want) and np.allclose(moves, want_moves)


def test_features_mark_the_edges_of_words():
    of, bucket = langid.gram_features(["ab", "b", "ab"])
    sets = [sorted(bucket[of == i]) for i in range(3)]
    assert sets[0] == sets[2] != sets[1] and len(sets[0]) == 2 + 3 + 2 + 1 and len(sets[1]) == 1 + 2 + 1


def test_code_switched_words_get_their_own_language():
    tokens, both = langid.label_words(model(), ["the dog and the house\nder hund und das haus"])
    words = [tokens.distinct[c] for c in tokens.codes]
    best = {w: model().languages[k] for w, k in zip(words, both.argmax(1))}
    assert best["the"] == "en" and best["hund"] == "de" and best["und"] == "de"


def test_predictions_and_defined_cases(spark):
    names, scores = langid.predict_batch(model(), ["the dog sleeps", "der hund", "", "123 !", EN[0].upper()])
    assert names == ["en", "de", "und", "und", "en"] and scores[2] == scores[3] == 0 and all(0 <= s <= 1 for s in scores)
    docs = documents(spark, [*EN, *EN, *AWKWARD], lang="en").unionByName(documents(spark, [(100 + i, t) for i, t in enumerate(DE * 3)], lang="de"))
    rows = {r.doc_id: r for r in langid.languages(docs).collect()}
    assert len(rows) == docs.count() and rows[6].lang_pred == "und" and rows[7].lang_pred == "und" and rows[14].lang_pred == "und"
    assert all(rows[100 + i].lang_pred == "de" for i in range(9))
    clash = docs.withColumn("lang_pred", F.lit("zz")).withColumn("score", F.lit(5))
    kept = langid.accepted(clash)
    assert kept.columns == clash.columns and {r.lang_pred for r in kept.collect()} == {"zz"} and kept.where("text is null").count() == 0
    assert langid.languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_noise_and_foreign_texts_go_and_code_switched_ones_stay(spark):
    r = np.random.default_rng(3)
    words = {"en": " ".join(EN).split(), "de": " ".join(DE).split()}
    clean = [(i, " ".join(r.choice(words[lang], 25)), lang) for i in range(120) for lang in [("en", "de")[i % 2]]]
    switched = [(1000 + i, " ".join([*r.choice(words["en"], 14), *r.choice(words["de"], 11)]), "en") for i in range(5)]
    noise = [(2000 + i, " ".join("".join(r.choice(list("bcfjkpqvxyz"), 6)) for _ in range(25)), None) for i in range(5)]
    foreign = [(3000, "все люди рождаются свободными и равными в своем достоинстве и правах", None),
               (3001, "人人 生而 自由 在 尊严 和 权利 上 一律 平等", None)]
    docs = spark.createDataFrame(clean + switched + noise + foreign, "doc_id bigint, text string, lang string")
    kept = {r.doc_id for r in langid.accepted(docs).collect()}
    assert not {i for i in kept if i >= 2000} and {1000 + i for i in range(5)} <= kept and len(kept) >= 122


def test_long_texts_teach_by_a_span(spark):
    docs = documents(spark, [(i, " ".join(DE * 300)) for i in range(4)], lang="de").unionByName(documents(spark, [(10 + i, t) for i, t in enumerate(EN)]))
    texts, labels = langid.sample(docs, F.lit(True))
    assert sorted(labels) == ["de"] * 4 + ["en"] * 3 and {len(t) for t, lang in zip(texts, labels) if lang == "de"} == {langid.DOC_CHARS}


def test_only_letters_make_words():
    assert langid.words_of("x² ½ Ⅻ ③ Straße\nà 12a_b 漢字") == ["x", "straße", "\n", "à", "a", "b", "漢字"]
    assert langid.words_of("²½ Ⅻ ١٢") == []
