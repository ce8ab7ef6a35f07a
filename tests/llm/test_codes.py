import hashlib
from math import floor

import numpy as np
import pytest
from compare import difference, duck

from entitynet.llm import codes
from entitynet.llm.checks_sql import CHECKS
from entitynet.llm.queries import QUERIES


def table(spark, rows, more=""):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int" + more)


def slow(rows, parts, entries, rounds, scale):
    """(code, error) by vec_id, and the codebooks, in plain Python."""
    kept = sorted((r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[floor(x * scale) if abs(x) < 2 ** 50 else int(x) * scale for x in r[1]] for r in kept]
    width = len(ints[0]) // parts
    cut = [[v[i * width:(i + 1) * width] for v in ints] for i in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books, best = [c[:entries] for c in cut], None
    for turn in range(rounds + 1):
        best = [[min((far(x, e), k) for k, e in enumerate(b)) for x in c] for c, b in zip(cut, books)]
        for i in range(parts if turn < rounds else 0):
            for k in range(len(books[i])):
                mine = [x for x, (_, at) in zip(cut[i], best[i]) if at == k]
                if mine:
                    books[i][k] = [sum(v) // len(mine) for v in zip(*mine)]
    return [(r[0], [best[i][n][1] for i in range(parts)], sum(best[i][n][0] for i in range(parts))) for n, r in enumerate(kept)], books


def check(spark, rows, parts=4, entries=5, rounds=3, scale=64):
    docs = table(spark, rows)
    books = codes.train(docs, parts=parts, entries=entries, rounds=rounds, scale=scale)
    got = sorted((r.vec_id is None, r.vec_id or 0, r.code, int(r.error)) for r in codes.encode(docs, books, scale=scale).collect())
    want, plain = slow(rows, parts, entries, rounds, scale)
    assert [b.tolist() for b in books] == plain
    assert got == sorted((i is None, i or 0, c, e) for i, c, e in want)


@pytest.mark.parametrize("width", [4, 12, 28])
def test_codes_meet_plain_distances(spark, width):
    r = np.random.default_rng(width)
    rows = [(i, r.normal(size=width).round(2).tolist(), 0) for i in range(300)]
    check(spark, rows)


def test_ties_repeats_and_unusable_vectors(spark):
    r = np.random.default_rng(1)
    rows = [(i, r.integers(-2, 3, 8).astype(float).tolist(), None) for i in range(60)]
    rows += [(5, [0.0] * 8, 1), (5, [1.0] * 8, 1), (None, [0.5] * 8, 1), (None, None, 1), (7, None, 2), (8, [float("nan")] + [0.0] * 7, 0),
             (9, [None] + [0.0] * 7, 0), (1, [float("-inf")] * 8, 0), (2, [float("inf")] + [1.0] * 7, 0)]
    check(spark, rows, scale=4)
    check(spark, rows[:3], scale=4)


def test_values_beyond_64_bits_stay_exact(spark):
    r = np.random.default_rng(2)
    check(spark, [(i, (r.normal(size=4) * 10.0 ** r.integers(0, 13)).tolist(), 0) for i in range(40)], scale=4096)


def test_no_vectors_clashing_columns_and_unlike_lengths(spark):
    empty = table(spark, [])
    books = codes.train(empty)
    assert codes.encode(empty, books).count() == 0 and codes.digest(books) == hashlib.sha256(b"").hexdigest()
    rows = [(i, [float(i)] * 8, i, f"k{i}", 1.5, i) for i in range(4)]
    docs = table(spark, rows, ", code string, error double, _vector_of_code int")
    got = codes.encode(docs, codes.train(docs)).collect()
    assert [(r.vec_id, r.label, r.code, int(r.error), r._vector_of_code) for r in got] == [(i, i, [i] * 8, 0, i) for i in range(4)]
    nothing = table(spark, [(i, [], 0) for i in range(3)])
    assert [(r.code, int(r.error)) for r in codes.encode(nothing, codes.train(nothing)).collect()] == [([0] * 8, 0)] * 3
    with pytest.raises(ValueError, match="do not divide"):
        codes.train(table(spark, [(1, [1.0] * 9, 0)]))
    with pytest.raises(Exception, match="unlike length"):
        codes.train(table(spark, [(i, [1.0] * (8 if i < 20 else 16), 0) for i in range(30)]))


def test_transform_is_in_sequency_order_and_keeps_distances():
    basis = codes.walsh(np.eye(16, dtype=np.int64)).T
    assert [(np.diff(row) != 0).sum() for row in basis] == list(range(16))
    x = np.random.default_rng(0).integers(-99, 99, (2, 11))
    assert ((codes.walsh(x)[0] - codes.walsh(x)[1]) ** 2).sum() == 16 * ((x[0] - x[1]) ** 2).sum()


def test_query_equals_its_sql_on_rows_with_null_labels(spark, tmp_path):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(size=16).tolist(), None if i % 3 == 0 else i % 4) for i in range(200)] + [(300, None, 1), (301, [float("nan")] * 16, None)]
    table(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(CHECKS["op13_walsh_codes"]).df()
    assert len(want) == 200 and difference(QUERIES["op13_walsh_codes"](spark, str(tmp_path)).toPandas(), want) is None
