import random

import numpy as np
import pytest
import xxhash
from helpers import AWKWARD, documents

from entitynet.llm import simhash
from entitynet.llm.components import components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1 if words else 0))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def slow_classes(ids, prints, distance=4):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                label = [label[j] if x == label[i] else x for x in label]
    return {d: min(x for x, l in zip(ids, label) if l == label[i]) for i, d in enumerate(ids)}


def near_texts():
    r = random.Random(3)
    base = [" ".join(r.choice("abcdefghij") * 2 for _ in range(80)).split() for _ in range(3)]
    texts = [" ".join(base[i % 3][:k] + ["new"] + base[i % 3][k + 1:]) for i in range(30) for k in [r.randrange(80)]]
    return [*texts, *[" ".join(b) for b in base], *AWKWARD[:5], AWKWARD[7], "one two three", "One  two\nthree", "x y z w", texts[0]]


def test_fingerprints_match_the_definition():
    for text in near_texts():
        assert simhash.fingerprint(None if text is None else text.encode(), 4, 42) % 2**64 == slow_fingerprint(text)


@pytest.mark.parametrize("largest", [20_000, 2])
def test_classes_match_brute_force(spark, largest):
    texts = near_texts()
    rows = simhash.classes(documents(spark, texts), largest=largest).collect()
    prints = [slow_fingerprint(t) for t in texts]
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {r.doc_id: r.component_id for r in rows} == slow_classes(range(len(texts)), prints)


@pytest.mark.parametrize("distance,count", [(4, 10), (4, 10**6), (4, 10**11), (3, 1000), (2, 50)])
def test_every_close_pair_shares_a_block_choice(distance, count):
    masks = simhash.choices(count, distance)
    r = random.Random(1)
    for _ in range(500):
        difference = sum(1 << b for b in r.sample(range(64), distance))
        assert any(not difference & m for m in masks)


def test_forest_connects_what_links_connect():
    r = np.random.default_rng(0)
    members = np.unique(r.integers(0, 1 << 12, 200))
    edges = simhash.forest(members, 1)
    assert len(edges) < len(members) and all((a ^ b).bit_count() == 1 for a, b in edges)


def test_components_of_paths_stars_and_self_links(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame([*path, *star, (500, 500), (7, None), (3, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(links.limit(0)).count() == 0


def test_representatives_repeats_nulls_and_empty(spark):
    docs = documents(spark, [(5, "a b c d e"), (3, "A b c d e"), (9, "z y x w v u"), (9, "z y x w v u"), (None, "lone text here now then"), (2, None), (1, "")])
    kept = sorted((r.doc_id is None, r.doc_id or 0) for r in simhash.representatives(docs).collect())
    assert kept == [(False, 1), (False, 3), (False, 9), (False, 9), (True, 0)]
    assert simhash.classes(docs.limit(0)).count() == 0


def test_representatives_judge_each_row_by_its_own_class(spark):
    copy, other = "a b c d e f", "z y x w v u"
    docs = documents(spark, [(3, copy), (5, copy), (5, other), (None, copy), (None, "lone text here now"), (None, "lone text here now")])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in simhash.representatives(docs).collect())
    assert kept == [(False, 3, copy), (False, 5, other), (True, 0, "lone text here now")]
