"""Quality of documents by a generalised additive model with pairwise interactions.

A text is described by ``FEATURES``, shares and logarithms that hold for any language. Each
feature is cut into bins at quantiles, and the model is one table of additions to the log
odds for each feature, and one for each of a few pairs of features (Lou et al. 2013).
Boosting learns the tables in cycles: a shallow tree over the bins of one feature, fitted
to what all tables together leave over, then one of the next feature; when no cycle
helps the labels set aside any more, the pairs with the largest gain do likewise
with trees that cut both of their features once. A score is a sum of looked-up numbers.

The model is fitted on a bounded sample: about ``LABELLED`` documents of either label, chosen by
a hash of the id. Their numbers (not their texts) meet on the driver; the tables have at
most ``BINS`` x features + ``BINS`` squared x pairs numbers. Scoring reads every
text whole and shuffles nothing.

Defined cases: a null text is an empty one; an empty text has every feature 0; labels that
are null, or neither 0 nor 1, teach nothing, and of several labels of a document the largest
holds; without both labels every score is the smoothed share of label 1 (a half without any).
Repeated and null ids keep their rows. ``scored`` keeps every other column but the text; one named like
a result gives way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from entitynet.llm.tables import held_out, slices
from entitynet.session import cut

LABELLED = 10_000
BINS, PAIRS = 32, 8
#: Cycles over all tables at most, share of a tree that is added, weight against small leaves, and cycles without gain.
CYCLES, RATE, RIDGE, PATIENCE = 200, 0.1, 2.0, 10

FEATURES = [
    "words", "word_length", "word_length_spread", "upper", "upper_words", "digits", "symbols", "symbol_ends", "symbol_words", "punctuation",
    "distinct_words", "commonest_word", "stutter", "distinct_pairs", "line_words", "repeated_lines", "longest_line", "longest_word",
    "beyond_ascii", "words_a_stop", "capitalised", "byte_entropy",
]

_LOWER, _UPPER, _DIGIT, _SPACE, _POINT, _SYMBOL, _WIDE = range(7)
_KIND = np.full(256, _SYMBOL)
for _bytes, _kind in ((b"abcdefghijklmnopqrstuvwxyz", _LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"0123456789", _DIGIT), (b" \t\n\r\x0b\x0c", _SPACE), (b".,;:?'\"()-", _POINT)):
    _KIND[list(_bytes)] = _kind
_KIND[128:] = _WIDE


def features(text: bytes) -> list[float]:
    """The numbers of ``FEATURES``."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    data = np.frombuffer(text, np.uint8)
    kinds = _KIND[data]
    count = np.bincount(kinds, minlength=7)
    space = np.r_[True, kinds == _SPACE, True]
    starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
    lengths = ends - starts
    inside = lambda mask: np.add.reduceat(np.r_[mask, False].astype(np.int64), np.c_[starts, ends].ravel())[::2]
    letters = inside((kinds <= _UPPER) | (kinds == _WIDE))
    capitals = inside(kinds == _UPPER)
    known = inside(kinds == _DIGIT) + letters
    seen = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = np.bincount(data, minlength=256) / len(data)
    share = share[share > 0]
    cased = count[_LOWER] + count[_UPPER]
    stops = text.count(b".") + 1
    return [
        np.log1p(n), lengths.mean(), lengths.std(), count[_UPPER] / max(cased, 1), np.mean((capitals == letters) & (letters > 1)),
        count[_DIGIT] / len(data), count[_SYMBOL] / len(data), np.mean(kinds[ends - 1] == _SYMBOL), np.mean(known == 0), count[_POINT] / n,
        np.log1p(len(seen)) / np.log1p(n), max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, pairs / max(n - 1, 1),
        np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(max(map(len, lines))), np.log1p(lengths.max()),
        count[_WIDE] / len(data), np.log1p(n / stops), np.mean(kinds[starts] == _UPPER), -(share * np.log2(share)).sum(),
    ]


@dataclass
class Model:
    """Additions to the log odds: ``tables`` by feature and bin, ``pairs`` by two features and their bins."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(c, x[:, k], "right") for k, c in enumerate(self.cuts)]

    def log_odds(self, bins: list[np.ndarray], rows: int) -> np.ndarray:
        total = np.full(rows, self.intercept)
        for at, table in zip(bins, self.tables):
            total += table[at]
        for (i, j), table in self.pairs.items():
            total += table[bins[i], bins[j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(self.bins(x), len(x)), -30, 30)))


def worth(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """What a leaf with these sums of residuals and of weights takes off the loss."""
    return g * g / (h + RIDGE)


def tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to three leaves over ordered bins: each bin's addition. ``g``, ``h``: sums by bin."""
    bounds = [0, len(g)]
    for _ in range(2):
        best = (1e-9, None)
        for low, high in zip(bounds, bounds[1:]):
            left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
            if len(left_g):
                all_g, all_h = g[low:high].sum(), h[low:high].sum()
                gain = worth(left_g, left_h) + worth(all_g - left_g, all_h - left_h) - worth(all_g, all_h)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), low + k + 1))
        if best[1] is None:
            break
        bounds = sorted([*bounds, best[1]])
    out = np.zeros(len(g))
    for low, high in zip(bounds, bounds[1:]):
        out[low:high] = g[low:high].sum() / (h[low:high].sum() + RIDGE)
    return out


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the additions of the best tree that cuts both features once. ``g``, ``h``: sums by two bins."""
    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)

    def four(x: np.ndarray) -> list[np.ndarray]:
        c = x.cumsum(0).cumsum(1)
        a, up, left = c[:-1, :-1], c[:-1, -1:], c[-1:, :-1]
        return [a, up - a, left - a, c[-1, -1] - up - left + a]

    gs, hs = four(g), four(h)
    gain = sum(worth(a, b) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = [a[i, j] / (b[i, j] + RIDGE) for a, b in zip(gs, hs)]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = value
    return float(gain[i, j] - worth(g.sum(), h.sum())), out


def fit(x: np.ndarray, y: np.ndarray, aside: np.ndarray, pairs: int = PAIRS, cycles: int = CYCLES) -> Model:
    """The model for rows ``x`` with labels ``y``; the rows ``aside`` only decide when to stop."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(float(np.log(share / (1 - share))))
    if not 0 < y[~aside].sum() < (~aside).sum():
        return model
    for column in x[~aside].T:
        # Half of the cuts at quantiles of the rows, half at quantiles of the distinct values, which reach rare ones.
        halves = [np.quantile(v, np.arange(1, n) / n, method="higher") for v, n in ((column, BINS // 2), (np.unique(column), BINS // 2 + 1))]
        edges = np.unique(np.concatenate(halves))
        model.cuts.append(edges)
        model.tables.append(np.zeros(len(edges) + 1))
    bins = model.bins(x)
    total = model.log_odds(bins, len(x))
    teach = np.flatnonzero(~aside)

    def left_over() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total[teach]))
        return y[teach] - p, p * (1 - p)

    def loss() -> float:
        rows = aside if aside.any() else ~aside
        return float(np.mean(np.logaddexp(0, total[rows]) - y[rows] * total[rows]))

    def histogram(at: np.ndarray, shape: tuple[int, ...]) -> list[np.ndarray]:
        return [np.bincount(at[teach], w, int(np.prod(shape))).reshape(shape) for w in left_over()]

    def boost(places: list[tuple[np.ndarray, np.ndarray]], grow) -> None:
        """Cycles over the tables (place of each row, table); the best state of the rows aside stays."""
        nonlocal total
        best, since, kept = loss(), 0, [t.copy() for _, t in places]
        for _ in range(cycles):
            for at, table in places:
                more = RATE * grow(*histogram(at, table.shape))
                table += more
                total = total + more.ravel()[at]
            now = loss()
            if now < best - 1e-6:
                best, since, kept = now, 0, [t.copy() for _, t in places]
            else:
                since += 1
            if since >= PATIENCE:
                break
        for (at, table), old in zip(places, kept):
            total = total + (old - table).ravel()[at]
            table[:] = old

    boost(list(zip(bins, model.tables)), tree)
    place = lambda i, j: bins[i] * len(model.tables[j]) + bins[j]
    gains = {}
    for i in range(len(bins)):
        for j in range(i):
            gains[j, i] = quadrants(*histogram(place(j, i), (len(model.tables[j]), len(model.tables[i]))))[0]
    for i, j in sorted(gains, key=lambda k: (-gains[k], k))[:pairs]:
        model.pairs[i, j] = np.zeros((len(model.tables[i]), len(model.tables[j])))
    boost([(place(i, j), t) for (i, j), t in model.pairs.items()], lambda g, h: quadrants(g, h)[1])
    for at, table in zip(bins, model.tables):
        middle = float(np.average(table, weights=np.bincount(at, minlength=len(table))))
        table -= middle
        model.intercept += middle
    return model


def described(rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the features ``x`` of each row's whole text."""
    schema = StructType([f for f in rows.schema.fields if f.name in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = [features(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in schema.fields], pa.array(made, pa.list_(pa.float64()))], [*schema.names, "x"])

    whole = rows.select(*[f"`{n}`" for n in schema.names], F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(run, StructType(list(schema.fields)).add("x", ArrayType(DoubleType())))


def sample(docs: DataFrame, labels: DataFrame, label: str, where: Column, each: int = LABELLED) -> DataFrame:
    """(hash, label, x) of about ``each`` labelled documents of either label, twice as many at most."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & where).groupBy("doc_id").agg(F.max(label).alias("label"))
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("label") == 1, counts.get(1, 1)).otherwise(counts.get(0, 1)).cast("long")
    chosen = cut(known.where(F.pmod(F.xxhash64("doc_id"), share) < each).limit(4 * each))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("hash"), "label", "text")
    return described(rows, ["hash", "label"]).limit(4 * each)


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", where: Column | None = None) -> Model:
    """The model of the labelled documents for whose id ``where`` holds; a fifth of them only decides when to stop."""
    rows = sample(docs, labels, label, F.lit(True) if where is None else where).toPandas().sort_values(["hash", "label"], kind="stable")
    if rows.empty:
        return Model()
    x = np.array(rows["x"].to_list(), np.float64)
    order = np.lexsort([*x.T, rows["hash"]])
    x, y, marks = x[order], rows["label"].to_numpy(np.float64)[order], rows["hash"].to_numpy()[order]
    return fit(x, y, (marks >> 20) % 5 == 0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """Every row with ``score``, the model's probability of label 1, in place of its text."""
    kept = [f for f in docs.schema.fields if f.name not in ("text", "score")]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            x = np.array([features(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in part.column("text")], np.float64)
            yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], pa.array(model.score(x))], [*names, "score"])

    whole = docs.select(*[f"`{n}`" for n in names], F.col("text").cast("binary").alias("text"))
    return whole.mapInArrow(run, StructType(kept).add("score", DoubleType()))


def judged(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; only rows that are not held out teach."""
    model = learned(docs, labels, where=~held_out(F.col("doc_id")))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
