"""Toxicity of documents by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts and compatibility
forms to Latin, digits and signs that stand for letters to those letters, invisible
characters away, everything else to single spaces. Entries are whole words or word
beginnings; an entry's weight is its log odds between toxic and clean labelled texts. A
match inside an exception phrase does not count. The weight found is set against the
length of the text, and a logistic curve fitted to the labels turns both into the score.

The model is fitted on a bounded sample, ``TOXIC_DOCS`` toxic and ``CLEAN_DOCS`` clean
texts of at most ``DOC_CHARS`` characters. An entry's support is the number of different
neighbourhoods it is seen in, so that copies of one text count once. Scoring reads every
text whole.

Defined cases: a null text is an empty one; an empty text scores as a clean one of no
length; without a toxic label every score is 0.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from entitynet.llm.tables import held_out, slices
from entitynet.session import cut

TOXIC_DOCS, CLEAN_DOCS, DOC_CHARS = 1_500, 3_000, 20_000
#: Letters of the word beginnings that may become entries.
BEGINNINGS = (4, 5, 6, 7)
#: Standard errors by which an entry's log odds must exceed LEAST_ODDS.
SURE, LEAST_ODDS = 2.3, 1.0

# Letters that look like Latin ones, signs that stand for letters, and phrases in which an entry is harmless.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "ɡ": "g", "ı": "i", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"
EXCEPTIONS = ("trash can", "trash bag", "clown fish", "pond scum")

_FOLD = str.maketrans(LOOK_ALIKES | SIGNS | dict.fromkeys(INVISIBLE))
_WORD = re.compile(r"[^\W\d_]+")


def folded(text: str) -> list[str]:
    """The words of the folded text."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if "!" in text:
        text = re.sub(r"(?<=\w)!(?=\w)", "i", text)
    return _WORD.findall(text.translate(_FOLD))


@dataclass
class Model:
    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        """Entries and exception phrases, each led by a space; whole words and phrases end with one."""
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            whole = f" {' '.join(folded(phrase))} "
            machine.add_word(whole, (len(whole), 0.0))
        machine.make_automaton()
        return machine


def found(machine, words: list[str]) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the matches that no exception phrase covers."""
    if not len(machine) or not words:
        return []
    every = [(end - size + 1, end, weight) for end, (size, weight) in machine.iter(f" {' '.join(words)} ")]
    spared = sorted((a, b) for a, b, weight in every if not weight)
    if not spared:
        return every
    starts, reach = [a for a, _ in spared], list(accumulate((b for _, b in spared), max))
    # Of the phrases that start no later than a match, the one that reaches furthest covers it if any does.
    return [m for m in every if m[2] and not ((k := bisect_right(starts, m[0])) and reach[k - 1] >= m[1])]


def evidence(machine, text: str) -> tuple[float, float]:
    """Logarithms of the weight found, and of the weight found in a hundred words."""
    words = folded(text)
    total = sum(w for *_, w in found(machine, words))
    return float(np.log1p(total)), float(np.log1p(100 * total / max(len(words), 1)))


def score(model: Model, machine, text: str) -> float:
    if not model.entries:
        return 0.0
    a, b = evidence(machine, text)
    return float(1 / (1 + np.exp(-(model.curve[0] + model.curve[1] * a + model.curve[2] * b))))


def sample(docs: DataFrame, labels: DataFrame, where: Column, toxic_docs: int = TOXIC_DOCS, clean_docs: int = CLEAN_DOCS) -> DataFrame:
    """(text, toxic) of about so many labelled documents, chosen by a hash of their id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & where).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    each = {1: toxic_docs, 0: clean_docs}
    share = F.when(F.col("toxic") == 1, max(counts.get(1, 0), 1)).otherwise(max(counts.get(0, 0), 1)).cast("long")
    most = F.when(F.col("toxic") == 1, each[1]).otherwise(each[0])
    chosen = cut(known.where(F.col("toxic").isin(0, 1) & (F.pmod(F.xxhash64("doc_id"), share) < most)).limit(2 * sum(each.values())))
    return cut(docs.where(F.char_length("text") <= DOC_CHARS).select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic"))


def contexts(rows: DataFrame) -> DataFrame:
    """(entry, toxic, around) of each text's words and word beginnings, where they stand first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            seen: set[tuple[str, int, int]] = set()
            for text, toxic in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist()):
                words = ["", *folded(text), ""]
                first: dict[str, int] = {}
                for i in range(len(words) - 2, 0, -1):
                    first[words[i]] = i
                starts = {f" {w} ": i for w, i in first.items()}
                for w, i in sorted(first.items(), key=lambda x: -x[1]):
                    for n in BEGINNINGS:
                        if len(w) >= n:
                            starts[f" {w[:n]}"] = i
                seen.update((e, toxic, zlib.crc32(f"{words[i - 1]} {words[i + 1]}".encode())) for e, i in starts.items())
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*seen), (pa.string(), pa.int32(), pa.int64()))], ["entry", "toxic", "around"])

    return rows.mapInArrow(run, "entry string, toxic int, around bigint")


def fit(rows: DataFrame, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """Entries with their weights, learned exception phrases, and the curve."""
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Model()
    odds = F.log((F.col("t") + 0.5) / (n[1] + 1)) - F.log((F.col("c") + 0.5) / (n[0] + 1))
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    counted = contexts(rows).distinct().groupBy("entry").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c"))
    strong = counted.withColumn("weight", odds).where((F.col("weight") - SURE * spread) > LEAST_ODDS)
    # All of them: the sample bounds their number, and an entry needs several toxic neighbourhoods.
    listed = strong.orderBy(F.desc("t"), F.length("entry"), "entry").collect()
    model = Model(distinct_entries({r.entry: (r.weight, r.t) for r in listed}), exceptions)
    machine = model.automaton()
    kept = rows.limit(2 * (TOXIC_DOCS + CLEAN_DOCS)).toLocalIterator()
    data, phrases = [], {}
    for r in kept:
        words = folded(r.text)
        joined = f" {' '.join(words)} "
        hits = found(machine, words)
        for a, b, _ in hits:
            after = joined.find(" ", max(b, a + 1))
            nearby = {joined[joined.rfind(" ", 0, a) + 1:after] if a else "", joined[a + 1:joined.find(" ", after + 1)] if after + 1 < len(joined) else ""}
            for p in nearby - {""}:
                phrases.setdefault(p.strip(), ([], []))[r.toxic].append(1)
        total = sum(w for *_, w in hits)
        data.append((log(1 + total), log(1 + 100 * total / max(len(words), 1)), r.toxic))
    learned = tuple(sorted(p for p, (clean, toxic) in phrases.items() if not toxic and len(clean) >= 5 and " " in p))
    return Model(model.entries, (*exceptions, *learned), curve(np.array(data)))


def distinct_entries(found: dict[str, tuple[float, int]]) -> dict[str, float]:
    """Of entries that begin with one another, the longest that still covers nine tenths of the shorter.

    A shorter entry that covers more stays instead, unless the longer weighs clearly more.
    """
    dropped: set[str] = set()
    for entry in sorted(found, key=len, reverse=True):
        weight, support = found[entry]
        for shorter in (entry[:n] for n in range(2, len(entry)) if entry[:n] in found):
            if 0.9 * found[shorter][1] <= support:
                dropped.add(shorter)
            elif weight <= found[shorter][0] + 1:
                dropped.add(entry)
    return {e: w for e, (w, _) in found.items() if e not in dropped}


def curve(data: np.ndarray, ridge: float = 0.01, steps: int = 30) -> tuple[float, float, float]:
    """Logistic regression of the last column on the others by Newton's method."""
    x, y = np.c_[np.ones(len(data)), data[:, :2]], data[:, 2]
    w = np.zeros(3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3), x.T @ (y - p) - ridge * w)
    return tuple(map(float, w))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; only rows that are not held out teach."""
    model = fit(sample(docs, labels, ~held_out(F.col("doc_id"))))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value.automaton()
        for part in slices(batches, "text"):
            values = [score(shared.value, machine, t or "") for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
