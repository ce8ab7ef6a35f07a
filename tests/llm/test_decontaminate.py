import hashlib
import random
import re

import pytest
from helpers import AWKWARD, documents

from entitynet.llm import decontaminate
from entitynet.llm.decontaminate import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(texts, items, window=10):
    out = {}
    for d, text in enumerate(texts):
        w, hit, named = words(text), set(), set()
        for item, item_text in items:
            i = words(item_text)
            n = min(window, len(i))
            for k in range(len(i) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == i[k:k + n]:
                        hit.update(range(p, p + n))
                        named.add(str(item))
        out[d] = (len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit))
    return out


def test_words_follow_the_pattern():
    text = "Aa-B9_é漢 x\x7fy\x00z[İ]"
    assert [w.decode() for w in words_of(text.encode())] == words(text)


@pytest.mark.parametrize("block_words", [500_000, 12])
def test_report_matches_brute_force(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block_words)
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block_words,))
    r = random.Random(4)
    alphabet = "a b c d é".split()
    text = lambda n: " ".join(r.choice(alphabet) for _ in range(n))
    items = [(1, text(12)), (2, text(3)), (10, text(25)), (2, text(4)), (7, ""), (8, None), (9, "Zz")]
    texts = [text(60) for _ in range(12)] + [items[0][1], f"q {items[2][1]} q", *AWKWARD[:5], "zz", "zz. ZZ"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(documents(spark, texts), bench).collect()}
    assert got == brute(texts, items)


def test_proximity_needs_the_words_close_together_in_any_order(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    texts = ["three two one", "one x x two x three", "one " + "x " * 30 + "two three", "one two", "three", "one two", "three one"]
    got = {r.doc_id: r.n_near for r in decontaminate.report(documents(spark, texts), bench, near=20).collect()}
    assert got == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0, 5: 0, 6: 0}


def test_awkward_texts_empty_tables_and_clean(spark):
    bench = spark.createDataFrame([(1, "a b c a b c a b c a b c")], "item_id bigint, text string")
    docs = documents(spark, AWKWARD)
    got = {r.doc_id: r for r in decontaminate.report(docs, bench).collect()}
    assert got[5].n_words == 120_000 and got[5].n_hit == 120_000 and not any(got[i].contaminated for i in range(9) if i != 5)
    assert sorted(r.doc_id for r in decontaminate.clean(docs, bench).collect()) == [0, 1, 2, 3, 4, 6, 7, 8]
    assert decontaminate.clean(docs, bench).columns == docs.columns
    assert decontaminate.report(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.report(docs, bench.limit(0)).collect())


def test_rows_go_by_their_own_text_not_by_their_id(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id bigint, text string")
    docs = documents(spark, [(None, "one two three"), (None, "clean"), (4, "x one two three"), (4, "clean too"), (5, "one")])
    assert sorted(r.text for r in decontaminate.clean(docs, bench).collect()) == ["clean", "clean too", "one"]


@pytest.mark.parametrize("block_words", [500_000, 12])
def test_clean_stores_an_index_for_several_passes_only(spark, monkeypatch, block_words):
    monkeypatch.setattr(decontaminate.item_blocks, "__defaults__", (block_words,))
    stored = []
    monkeypatch.setattr(decontaminate, "build_index", lambda docs, build=decontaminate.build_index: stored.append(1) or build(docs))
    r = random.Random(5)
    text = lambda n: " ".join(r.choice("a b c d é".split()) for _ in range(n))
    items = [(1, text(12)), (2, text(25)), (3, ""), (4, None), (5, "Zz")]
    texts = [text(60) for _ in range(12)] + [items[0][1], f"q {items[1][1]} q", *AWKWARD[:5], "zz. ZZ"]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = [d for d, found in brute(texts, items).items() if not found[-1]]
    assert sorted(r.doc_id for r in decontaminate.clean(documents(spark, texts), bench).collect()) == want
    assert len(stored) == (block_words == 12)
    assert decontaminate.clean(documents(spark, texts), bench.limit(0)).count() == len(texts)
