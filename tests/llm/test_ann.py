import numpy as np
import pytest

from entitynet.llm import ann


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")


def exact(ids, vectors, query, k=10):
    d = np.sqrt(np.add.accumulate(((vectors - vectors[query]) ** 2).T, axis=0)[-1])
    return [(ids[i], d[i]) for i in np.lexsort((ids, d)) if ids[i] != ids[query]][:k]


@pytest.mark.parametrize("cell", [20_000, 60])
def test_recall_ranks_and_scores(spark, monkeypatch, cell):
    monkeypatch.setattr(ann, "CELL", cell)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 24))
    vectors = (centres[r.integers(0, 6, 1200)] + 0.4 * r.normal(size=(1200, 24))).astype(np.float32)
    got = ann.neighbours(table(spark, [(i, v.tolist(), 0) for i, v in enumerate(vectors)]), lambda i: i % 100 == 0).toPandas()
    wide, hits = vectors.astype(np.float64), 0
    for q in range(0, 1200, 100):
        rows = got[got.query_id == q].sort_values("rank")
        assert rows["rank"].to_list() == list(range(1, 11)) and rows.score.is_monotonic_increasing
        want = exact(np.arange(1200), wide, q)
        hits += len({i for i, _ in want} & set(rows.vec_id))
        d = np.sqrt(np.add.accumulate(((wide - wide[q]) ** 2).T, axis=0)[-1])
        assert (d[rows.vec_id] == rows.score).all()
    assert hits / 120 >= 0.9


def test_copies_ties_and_rows_that_take_no_part(spark):
    one, nan = [1.0, 0.0], float("nan")
    rows = [(i, one, 0) for i in range(40, 0, -1)] + [(0, [0.0, 1.0], 0), (50, None, 0), (51, [0.0, 0.0], 0), (52, [nan, 1.0], 0), (53, [None, 1.0], 0),
            (54, [float("inf"), 1.0], 0), (55, [], 0), (None, one, 0), (100, one, 0), (100, one, 0), (200, [nan, nan], 0), (56, [1.0, 2.0, 3.0], 0)]
    got = ann.neighbours(table(spark, rows), lambda i: i % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, i) for i in range(1, 11)] + [(100, i) for i in range(1, 11)]
    assert all(r.score == 0 for r in got if r.query_id == 100)


def test_few_candidates_and_empty_tables(spark):
    got = ann.neighbours(table(spark, [(0, [1.0, 2.0], 0), (1, [2.0, 1.0], 0), (2, [3.0, 3.0], 0)]), lambda i: i % 100 == 0).collect()
    assert sorted(r.vec_id for r in got) == [1, 2]
    assert ann.neighbours(table(spark, [(0, [1.0], 0)]), lambda i: i % 100 == 0).count() == 0
    empty = ann.neighbours(table(spark, []), lambda i: i % 100 == 0)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_chi_square_factor_and_planes():
    x = np.random.default_rng(0).chisquare(8, 400_000)
    assert abs((x <= ann.radius_factor(0.97, 8)).mean() - 0.97) < 0.002
    points = np.random.default_rng(1).normal(size=(1000, 8))
    leaf = ann.leaf_of(points, *ann.split_planes(points, 3))
    assert set(leaf) == set(range(8)) and np.bincount(leaf).max() <= 130
