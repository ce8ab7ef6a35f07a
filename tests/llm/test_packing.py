import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from entitynet.llm.packing import Tokens, first_fit, pack, tokens_of
from entitynet.llm.queries import TOKENIZER
from entitynet.llm.tables import BATCH_BYTES, small_batches

ALPHABET = "abcXYZ éÉßÿŸŁłœŒ'’ss't're 0123²¼½ª¹º\t\n  .,;!?<|endoftext|>İıſΣσς\xa0\x85\xad漢字́ﬁ§±×÷_-"


@pytest.fixture(scope="module")
def tokens():
    return Tokens(TOKENIZER)


def test_ids_equal_the_tokenizers(tokens):
    r = random.Random(1)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(2000)]
    texts += [t or "" for t in AWKWARD if len(t or "") < 1000]
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in tokens.of(texts)] == [x.ids for x in want]


def test_plain_words_are_split_as_the_tokenizer_splits_them(tokens):
    r = random.Random(2)
    texts = ["".join(r.choice("''''strevdlm  aÉß12²!.\n") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += ["", "'", "'s", "''s", "'s's", "'re'", "x'r", "x'll", "'ve1'd\n", " \t\r\n"]
    want = tokens.tokenizer.encode_batch(texts, add_special_tokens=False)
    assert [x.tolist() for x in tokens.of(texts)] == [x.ids for x in want]
    found, before = tokens.words(["It's 10", "", "l'État"])
    assert found.to_pylist() == ["it", "'s", "1", "0", "l", "'", "état"] and before.tolist() == [0, 4, 4]


def test_tasks_of_a_worker_share_the_words_they_know():
    first = tokens_of(TOKENIZER)
    first.of(["some known words"])
    assert tokens_of(TOKENIZER) is first and "known" in first.known


@given(st.lists(st.integers(1, 50), max_size=60))
@settings(max_examples=60, deadline=None)
def test_first_fit_matches_a_plain_scan(sizes):
    sizes = sorted(sizes, reverse=True)
    room, want = [], []
    for s in sizes:
        k = next((i for i, r in enumerate(room) if r >= s), len(room))
        if k == len(room):
            room.append(50)
        want.append((k, 50 - room[k]))
        room[k] -= s
    bins, offsets = first_fit(np.array(sizes, np.int64), 50)
    assert list(zip(bins.tolist(), offsets.tolist())) == want


@pytest.mark.parametrize("group_pieces", [20_000, 10])
def test_every_id_is_packed_once(spark, tokens, group_pieces):
    texts = [*AWKWARD, *[f"some words number {i} " * (i % 40) for i in range(60)]]
    got = pack(documents(spark, texts), TOKENIZER, length=256, group_pieces=group_pieces, keep_ids=True).toPandas()
    for doc_id, rows in got.sort_values("start").groupby("doc_id"):
        ids = [*tokens.tokenizer.encode(texts[doc_id] or "", add_special_tokens=False).ids, 2]
        assert np.concatenate(rows.ids.to_list()).tolist() == ids and set(rows.doc_tokens) == {len(ids)}
        assert [zlib.crc32(np.array(x, "<u4").tobytes()) for x in rows.ids] == rows.ids_crc32.to_list()
    for _, rows in got.sort_values("offset").groupby("sequence_id"):
        assert rows.offset.to_list() == [0, *rows.length.cumsum().to_list()[:-1]] and rows.length.sum() <= 256
    assert set(got.doc_id) == set(range(len(texts)))


def test_repeated_rows_and_empty_tables(spark):
    docs = documents(spark, [(1, "a"), (1, "a"), (None, None)])
    got = pack(docs, TOKENIZER).toPandas()
    assert got.length.sort_values().to_list() == [1, 2, 2] and got.sequence_id.nunique() == 1
    assert isinstance(pack(docs.limit(0), TOKENIZER).toPandas(), pd.DataFrame) and pack(docs.limit(0), TOKENIZER).count() == 0


def test_batches_of_text_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        small_batches(spark)
        docs = documents(spark, [f"{i} " + "word " * 20_000 for i in range(200)]).repartition(1)
        sizes = [r.n for r in docs.select("text").mapInArrow(lambda batches: (
            pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * BATCH_BYTES
        for held, after in (("1m", "1m"), ("64m", str(BATCH_BYTES))):
            spark.conf.set(name, held)
            small_batches(spark)
            assert spark.conf.get(name) == after
    finally:
        spark.conf.set(name, before)
