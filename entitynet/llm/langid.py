"""Language of words and documents by a linear-chain conditional random field.

A line of a text is a sequence of words. A word's score for a language is a sum of learned
weights of its character n-grams (those that touch a word's edge are its affixes) and of
its entry in a lexicon of the training words; learned transition weights join neighbours.
Forward-backward gives each word's probability of each language, so a code-switched text
has words of several languages; the document takes the language with the largest mean.

The model is fitted on the driver on a bounded sample: ``DOCS_EACH`` documents for each
language, of a longer text a random span of ``DOC_CHARS`` characters. Everything else runs
over all texts, whole.

Defined cases: a text that is null or has no letter is ``und`` with score 0; ties go to the
first language in alphabetical order; without any labelled row everything is ``und``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitynet.llm.tables import held_out, slices

DOCS_EACH = 150
DOC_CHARS = 8_000
#: Share of correctly predicted labelled texts below each bound of acceptance.
RATE = 0.01
STEPS = 40
#: Weight of the squared parameters against the mean log-likelihood of a word.
RIDGE = 1e-6
BUCKET_BITS = 16
ORDERS = (1, 2, 3, 4)
UNKNOWN = "und"
#: Languages that are learned at most, the commonest values of the column.
LANGUAGES = 200

_TOKEN = re.compile(r"[^\W\d_]+|\n")


@dataclass
class Model:
    languages: list[str]
    lexicon: dict[str, int]
    grams: np.ndarray
    words: np.ndarray
    moves: np.ndarray
    starts: np.ndarray


@dataclass
class Tokens:
    """Words of several texts: distinct words, each word's index among them, its text, and the lines."""

    distinct: list[str]
    codes: np.ndarray
    text: np.ndarray
    line_start: np.ndarray
    line_length: np.ndarray


def words_of(text: str) -> list[str]:
    """The runs of letters, and the line ends; numbers of any script (½, Ⅻ) part words like digits."""
    out = []
    for w in _TOKEN.findall(text.lower()):
        if w.isalpha() or w == "\n":
            out.append(w)
        else:
            out += "".join(c if c.isalpha() else " " for c in w).split()
    return out


def tokenize(texts: list[str]) -> Tokens:
    found = [words_of(t) for t in texts]
    flat = pa.array([w for x in found for w in (*x, "\n")], pa.string()).dictionary_encode()
    distinct, codes = flat.dictionary.to_pylist(), flat.indices.to_numpy()
    text = np.repeat(np.arange(len(texts)), [len(x) + 1 for x in found])
    word = codes != distinct.index("\n")
    line = np.cumsum(~word)[word]
    starts = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    return Tokens(distinct, codes[word], text[word], starts, np.diff(np.r_[starts, len(line)]))


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word index, bucket) of every character n-gram, edges marked, in the order of the words."""
    flat = np.frombuffer(("\1" + "\1".join(words) + "\1").encode("utf-32-le"), "<u4")
    edges = np.flatnonzero(flat == 1)
    at = np.arange(len(flat))
    owner = np.searchsorted(edges, at, "right") - 1
    room = edges[np.minimum(owner + 1, len(edges) - 1)] - at + 1
    hashed, of, bucket = np.zeros(len(flat), np.uint32), [], []
    for n in range(1, max(ORDERS) + 1):
        hashed = hashed[:len(flat) - n + 1] * np.uint32(0x01000193) + flat[n - 1:]
        if n in ORDERS:
            ok = np.flatnonzero((room[:len(hashed)] >= n) & (owner[:len(hashed)] < len(words)) & ((n > 1) | (flat[:len(hashed)] != 1)))
            of.append(owner[ok])
            bucket.append((hashed[ok] ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS))
    of, bucket = np.concatenate(of), np.concatenate(bucket)
    order = np.argsort(of, kind="stable")
    return of[order], bucket[order]


def word_scores(model: Model, words: list[str], features: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    of, bucket = features or gram_features(words)
    sums = np.vstack([np.zeros((1, len(model.languages))), np.cumsum(model.grams[bucket], axis=0, dtype=np.float64)])
    bounds = np.searchsorted(of, np.arange(len(words) + 1))
    known = np.fromiter((model.lexicon.get(w, len(model.lexicon)) for w in words), np.int64, len(words))
    return sums[bounds[1:]] - sums[bounds[:-1]] + model.words[known]


def forward_backward(scores: np.ndarray, model: Model, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probability of each language, and the expected number of moves between two languages.

    All lines take a step at a time, the longer lines first, so that those still running
    are the first rows of each array.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")
    local = np.exp(scores - scores.max(1, keepdims=True, initial=-np.inf))
    moves = np.exp(model.moves - model.moves.max())
    first = np.exp(model.starts - model.starts.max())
    ahead, behind = np.empty_like(local), np.ones_like(local)
    state = first
    for t, n in enumerate(running):
        at = start[:n] + t
        state = (state[:n] @ moves if t else first) * local[at]
        state /= state.sum(1, keepdims=True)
        ahead[at] = state
    for t in range(len(running) - 1, 0, -1):
        at = start[:running[t]] + t
        back = (local[at] * behind[at]) @ moves.T
        behind[at - 1] = back / back.sum(1, keepdims=True)
    both = ahead * behind
    both /= both.sum(1, keepdims=True)
    inside = np.ones(len(scores), bool)
    inside[start] = False
    to = np.flatnonzero(inside)
    right = local[to] * behind[to]
    norm = np.einsum("ti,ij,tj->t", ahead[to - 1], moves, right, optimize=True)
    expected = moves * ((ahead[to - 1] / norm[:, None]).T @ right)
    return both, expected


def fit(texts: list[str], labels: list[str], steps: int = STEPS, ridge: float = RIDGE, rate: float = 0.1) -> Model | None:
    """Maximise the likelihood of the labels by gradient ascent with adaptive steps (Adam)."""
    languages = sorted(set(labels))
    if not languages:
        return None
    tokens = tokenize(texts)
    size = len(languages)
    counts = np.bincount(tokens.codes, minlength=len(tokens.distinct))
    lexicon = {w: i for i, w in enumerate(w for w, n in zip(tokens.distinct, counts) if n > 1 and w != "\n")}
    model = Model(languages, lexicon, np.zeros((1 << BUCKET_BITS, size)), np.zeros((len(lexicon) + 1, size)),
                  np.zeros((size, size)), np.zeros(size))
    if not len(tokens.codes):
        return model
    index = {x: i for i, x in enumerate(languages)}
    truth = np.array([index[x] for x in labels])[tokens.text]
    of, bucket = features = gram_features(tokens.distinct)
    known = np.fromiter((lexicon.get(w, len(lexicon)) for w in tokens.distinct), np.int64, len(tokens.distinct))
    total = len(tokens.codes)
    inside = np.ones(total, bool)
    inside[tokens.line_start] = False
    to = np.flatnonzero(inside)
    seen_moves, seen_starts = np.zeros((size, size)), np.bincount(truth[tokens.line_start], minlength=size)
    np.add.at(seen_moves, (truth[to - 1], truth[to]), 1)
    parts = ("grams", "words", "moves", "starts")
    mean = {p: np.zeros_like(getattr(model, p)) for p in parts}
    square = {p: np.zeros_like(getattr(model, p)) for p in parts}
    sums = lambda where, values, n: np.stack([np.bincount(where, values[:, k], n) for k in range(size)], 1)
    for step in range(1, steps + 1):
        both, expected = forward_backward(word_scores(model, tokens.distinct, features)[tokens.codes], model, tokens.line_start, tokens.line_length)
        miss = -both
        miss[np.arange(total), truth] += 1
        by_word = sums(tokens.codes, miss, len(tokens.distinct))
        by_known = sums(known, by_word, len(lexicon) + 1)
        by_known[-1] = 0
        slope = {"grams": sums(bucket, by_word[of], 1 << BUCKET_BITS), "words": by_known, "moves": seen_moves - expected,
                 "starts": seen_starts - both[tokens.line_start].sum(0)}
        for p in parts:
            g = slope[p] / total - ridge * getattr(model, p)
            mean[p] = 0.9 * mean[p] + 0.1 * g
            square[p] = 0.99 * square[p] + 0.01 * g * g
            getattr(model, p)[...] += rate * (mean[p] / (1 - 0.9**step)) / (np.sqrt(square[p] / (1 - 0.99**step)) + 1e-8)
    model.grams = model.grams.astype(np.float32)
    return model


def sample(docs: DataFrame, where: Column, docs_each: int = DOCS_EACH, doc_chars: int = DOC_CHARS, turn: int = 0) -> tuple[list[str], list[str]]:
    """About ``docs_each`` texts of each language, chosen by a hash of their id, and their languages; another ``turn`` takes others.

    A text of more than ``doc_chars`` characters gives a span of that many from a place chosen by hash.
    """
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    commonest = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    counts = {r.lang: r.n for r in commonest.collect()}
    if not counts:
        return [], []
    rows = rows.where(F.col("lang").isin(*counts))
    share = F.create_map(*[F.lit(x) for pair in counts.items() for x in pair])[F.col("lang")]
    place = F.pmod(F.xxhash64("doc_id", "lang"), share)
    room = F.greatest(F.char_length("text") - doc_chars, F.lit(0)) + 1
    span = F.substring("text", (F.pmod(F.xxhash64("doc_id", "lang", F.lit("span")), room) + 1).cast("int"), F.lit(doc_chars))
    taken = rows.where((place >= turn * docs_each) & (place < (turn + 1) * docs_each)).withColumn("text", span).limit(2 * docs_each * len(counts))
    found = sorted(map(tuple, taken.collect()), key=repr)
    return [r[1] for r in found], [r[2] for r in found]


def label_words(model: Model, texts: list[str]) -> tuple[Tokens, np.ndarray]:
    """The words of the texts and their probabilities of each language."""
    tokens = tokenize(texts)
    if not len(tokens.codes):
        return tokens, np.empty((0, len(model.languages)))
    scores = word_scores(model, tokens.distinct)[tokens.codes]
    return tokens, forward_backward(scores, model, tokens.line_start, tokens.line_length)[0]


def judge_batch(model: Model | None, texts: list[str]) -> tuple[list[str], list[float], list[float], list[int]]:
    """The language of each text, its score, the share of its words that are in the lexicon, and their number."""
    names, values, familiar = [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
    if model is None:
        return names, values, familiar, [0] * len(texts)
    tokens, both = label_words(model, texts)
    counts = np.bincount(tokens.text, minlength=len(texts))
    means = np.stack([np.bincount(tokens.text, both[:, k], len(texts)) for k in range(len(model.languages))], 1) / np.maximum(counts, 1)[:, None]
    known = np.fromiter((w in model.lexicon for w in tokens.distinct), bool, len(tokens.distinct))
    shares = np.bincount(tokens.text, known[tokens.codes], len(texts)) / np.maximum(counts, 1)
    best = means.argmax(1)
    for i in np.flatnonzero(counts):
        names[i], values[i], familiar[i] = model.languages[best[i]], min(float(means[i, best[i]]), 1.0), float(shares[i])
    return names, values, familiar, counts.tolist()


def predict_batch(model: Model | None, texts: list[str]) -> tuple[list[str], list[float]]:
    return judge_batch(model, texts)[:2]


def predict(docs: DataFrame, model: Model | None, carry: list[str], text: str = "text") -> DataFrame:
    """The columns ``carry`` of ``docs`` with lang_pred, score, familiar and n_words, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    carry = [c for c in carry if c not in ("lang_pred", "score", "familiar", "n_words")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            names, values, familiar, counts = judge_batch(shared.value, [t or "" for t in part.column(text).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), pa.array(names, pa.string()), pa.array(values, pa.float64()),
                                              pa.array(familiar, pa.float64()), pa.array(counts, pa.int64())], [*carry, "lang_pred", "score", "familiar", "n_words"])

    return docs.select(*[f"`{c}`" for c in dict.fromkeys([*carry, text])]).mapInArrow(run, f"{fields}, lang_pred string, score double, familiar double, n_words bigint")


def train(docs: DataFrame, where: Column) -> Model | None:
    return fit(*sample(docs, where))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; only rows that are not held out teach."""
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def bounds(model: Model | None, texts: list[str], labels: list[str], rate: float) -> tuple[float, float]:
    """The ``rate`` quantiles of score and familiar words among the texts whose language is predicted right."""
    names, values, familiar, _ = judge_batch(model, texts)
    right = [i for i, (a, b) in enumerate(zip(names, labels)) if a == b]
    if not right:
        return 0.0, 0.0
    return float(np.quantile([values[i] for i in right], rate)), float(np.quantile([familiar[i] for i in right], rate))


def accepted(docs: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, all columns kept, whose language is known.

    A text goes if its score and its share of familiar words are both below what all but
    ``rate`` of the correctly predicted labelled texts reach. A text in two known languages
    has a low score but familiar words; noise and other languages have neither. It also goes,
    whatever its score, if its familiar words are by three standard deviations fewer than half
    of that bound: a model of few languages may be sure of one for words it has never seen.
    The bounds come from texts that did not teach, or from those that did where there are no others.
    """
    taught = ~held_out(F.col("doc_id"))
    texts, labels = sample(docs, taught)
    model = fit(texts, labels)
    fresh = sample(docs, taught, turn=1)
    least, familiar = bounds(model, *(fresh if len(fresh[0]) >= len(texts) / 2 else (texts, labels)), rate)
    # Each text goes to Python and back once, under a name that no result has.
    renamed = docs.select(*[F.col(f"`{c}`").alias(f"_{c}") for c in docs.columns])
    marked = predict(renamed, model, renamed.columns, "_text")
    strange = F.col("familiar") + 1.5 / F.sqrt(F.greatest("n_words", F.lit(1))) < familiar / 2
    return marked.where((F.col("lang_pred") != UNKNOWN) & ~strange & ((F.col("score") >= least) | (F.col("familiar") >= familiar))).select(
        *[F.col(f"`_{c}`").alias(c) for c in docs.columns])
