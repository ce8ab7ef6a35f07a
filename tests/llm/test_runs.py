import random

import numpy as np
from compare import duck
from helpers import AWKWARD, documents

from entitynet.llm import runs
from entitynet.llm.checks_sql import CHECKS
from entitynet.llm.queries import QUERIES


def slow(words, least=12):
    """(start, length, period) of all runs, period by period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def periodic(r, letters, size):
    words = [r.randrange(letters) for _ in range(size)]
    if size > 5 and r.random() < 0.6:
        a = r.randrange(size)
        p = 1 + (size - a) // r.choice([2, 3, 4, 7])
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(size)]
    return words


def test_runs_of_many_small_sequences_meet_brute_force():
    r = random.Random(1)
    for _ in range(150):
        texts = [periodic(r, r.choice([1, 2, 2, 3, 5]), r.randrange(60)) for _ in range(r.randrange(1, 6))]
        least = r.choice([2, 4, 12])
        got = runs.maximal_runs([np.array(t, np.int64) for t in texts], least, r.choice([7, 500_000]))
        assert list(zip(*[x.tolist() for x in got])) == [(k, *x) for k, t in enumerate(texts) for x in slow(t, least)]


def test_extensions_are_exact_both_ways():
    r = np.random.default_rng(4)
    inner = np.concatenate([np.tile(r.integers(1, 4, 7), 9), np.repeat(r.integers(1, 4, 20), r.integers(1, 9, 20))])
    s = np.r_[0, inner, 9]
    grammar = runs.Grammar(s)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(1, len(s) - 1), np.arange(1, len(s) - 1)))
    a, b = a[a != b], b[a != b]
    ahead, back = grammar.extension(a, b), grammar.extension(a, b, -1)
    for x, y, f, g in zip(a.tolist(), b.tolist(), ahead.tolist(), back.tolist()):
        assert (s[x:x + f] == s[y:y + f]).all() and (max(x, y) + f == len(s) or s[x + f] != s[y + f])
        assert (s[x - g + 1:x + 1] == s[y - g + 1:y + 1]).all() and s[x - g] != s[y - g]


def test_rows_of_awkward_texts_nulls_and_clashing_columns(spark):
    r = random.Random(3)
    texts = [*AWKWARD, "to be " * 9, *(" ".join(f"w{x}" for x in periodic(r, 3, 80)) for _ in range(20))]
    pairs = [(None if i % 7 == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = documents(spark, pairs).selectExpr("*", "n_chars AS _row", "'x' AS runs", "1 AS _kept")
    rows = runs.repeats(docs).collect()
    assert set(rows[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "_row", "_kept", "runs", "collapsed"}

    def wanted(text):
        words = (text or "").encode().split()
        words = [w.decode() for w in words]
        found = [(0, 120_000, 3)] if len(words) == 120_000 else slow(words)
        return found, " ".join(words[:3]) if len(words) == 120_000 else collapsed(words, found)

    got = sorted((x.doc_id is None, x.doc_id or 0, [tuple(y) for y in x.runs], x.collapsed) for x in rows)
    assert got == sorted((i is None, i or 0, *wanted(t)) for i, t in pairs)
    assert runs.repeats(docs.limit(0)).count() == 0


def test_query_equals_its_sql_on_awkward_rows(spark, tmp_path):
    r = random.Random(5)
    texts = [t for t in AWKWARD if len(t or "") < 1000] + [" ".join(f"w{x}" for x in periodic(r, k, 90)) for k in (1, 2, 3, 40) for _ in range(30)]
    pairs = [(None if i % 31 == 30 else i, t) for i, t in enumerate(texts)]
    documents(spark, pairs).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duck("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = [tuple(x) for x in QUERIES["op12_word_runs"](spark, str(tmp_path)).collect()]
    want = con.execute(CHECKS["op12_word_runs"]).fetchall()
    assert len(got) == len(pairs) and sorted(got, key=repr) == sorted(want, key=repr)
