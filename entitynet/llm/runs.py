"""Periodic runs of words: all maximal stretches that repeat with a period, exactly.

The words of a slice of documents, each document between words that stand nowhere else,
are recompressed (Jeż 2015): blocks of one symbol become one symbol, then pairs of a symbol of
one class and a symbol of the other do, in turns, until one symbol is left. Equal
stretches are cut alike but for their ends, so the common extension of two places (I 2017)
climbs the levels of this run-length grammar with at most one step on each, and descends into
the two symbols that differ. All queries of a slice go level by level together.

A run of period q and length 2q or more holds two neighbouring multiples of q. These grid
pairs, n log n of a text of n words, are the candidates: where their words are equal, both
extensions give the stretch. Of the periods of one stretch the smallest is its period.

Defined cases: a null text has no words; words lie between ASCII white space and compare
by their bytes; a text is always worked on whole, a longer one than a slice alone, with
candidates in pieces of bounded size. Rows are independent: null or repeated ids and
repeated rows keep their rows. Every other column is kept; one named ``runs`` or ``collapsed`` gives
way to the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructType

from entitynet.llm.tables import slices

#: Words of the shortest run.
LEAST = 12
#: Grid pairs worked on at once.
PIECE = 500_000


class Grammar:
    """Levels of recompression of a sequence whose first and last symbols stand nowhere else."""

    def __init__(self, symbols: np.ndarray):
        #: For each level its symbols and their parents; for each but the first the children's bounds.
        self.symbols, self.parents, self.first, self.last = [symbols], [], [symbols[:0]], [symbols[:0]]
        turn = 0
        while len(self.symbols[-1]) > 1:
            now = self.symbols[-1]
            if turn % 2 == 0:
                starts = np.r_[True, now[1:] != now[:-1]]
                at = np.flatnonzero(starts)
                more = np.diff(np.r_[at, len(now)]) - 1
            else:
                high = (now * 0x9E3779B1 + turn * 0x85EBCA77 >> 13 ^ now >> 3) & 1 == 1
                up, down = ~high[:-1] & high[1:], high[:-1] & ~high[1:]
                second = np.r_[False, up if up.sum() >= down.sum() else down]
                starts = ~second
                at = np.flatnonzero(starts)
                follows = np.r_[at[1:], len(now)] - at > 1
                more = np.where(follows, now[np.minimum(at + 1, len(now) - 1)] + 1, 0)
            turn += 1
            if len(at) < len(now):
                self.parents.append(np.cumsum(starts) - 1)
                self.first.append(at)
                self.last.append(np.r_[at[1:], len(now)] - 1)
                self.symbols.append(pd.factorize((now[at] << 32) | more)[0])

    def extension(self, a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
        """How many words from ``a`` on are those from ``b`` on, to the right or (-1) to the left; a and b differ."""
        a_at, b_at = a.copy(), b.copy()
        stopped = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        for level, parent in enumerate(self.parents):
            near, far = (self.first, self.last)[::sign]
            near, far, symbols = near[level + 1], far[level + 1], self.symbols[level]
            x, y = a_at[live], b_at[live]
            up_x, up_y = parent[x], parent[y]
            whole = (near[up_x] == x) & (near[up_y] == y)
            equal = symbols[x] == symbols[y]
            step = np.where(~whole & equal, np.minimum((far[up_x] - x) * sign, (far[up_y] - y) * sign) + 1, 0)
            x, y = x + sign * step, y + sign * step
            passed = (step > 0) & (x - sign == far[up_x]) & (y - sign == far[up_y])
            climbs = whole | passed
            a_at[live] = np.where(climbs, up_x + sign * passed, x)
            b_at[live] = np.where(climbs, up_y + sign * passed, y)
            stopped[live] = level
            live = live[climbs]
            stopped[live] = level + 1
            if not len(live):
                break
        for level in range(int(stopped.max(initial=0)), 0, -1):
            on = np.flatnonzero(stopped >= level)
            near = (self.first, self.last)[::sign][0][level]
            first, last, symbols = self.first[level], self.last[level], self.symbols[level - 1]
            x, y = a_at[on], b_at[on]
            sizes = last[x] - first[x] + 1, last[y] - first[y] + 1
            x, y = near[x], near[y]
            # Equal first children of different symbols: a pair's seconds differ, or a block goes on beyond the other.
            step = np.where(symbols[x] == symbols[y], np.where(sizes[0] == sizes[1], 1, np.minimum(*sizes)), 0)
            a_at[on], b_at[on] = x + sign * step, y + sign * step
        return np.abs(a_at - a)


def maximal_runs(texts: list[np.ndarray], least: int = LEAST, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs of the sequences of whole numbers, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    marks = top + np.arange(len(texts) + 1)
    sequence = np.concatenate([marks[:1], *[x for t, m in zip(texts, marks[1:]) for x in (t, [m])]]).astype(np.int64)
    offsets = np.cumsum(np.r_[1, sizes[:-1] + 1])
    grammar = Grammar(pd.factorize(sequence)[0])
    sequence = grammar.symbols[0]
    grid_text = np.repeat(np.arange(len(texts)), sizes // 2)
    period = np.arange(len(grid_text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    pairs = (sizes[grid_text] - 1) // period
    ends = np.cumsum(pairs)
    found = []
    for low in range(0, int(ends[-1]) if len(ends) else 0, piece):
        flat = np.arange(low, min(low + piece, int(ends[-1])))
        row = np.searchsorted(ends, flat, "right")
        q = period[row]
        i = offsets[grid_text[row]] + (flat - (ends - pairs)[row]) * q
        hit = np.flatnonzero(sequence[i] == sequence[i + q])
        i, q, text = i[hit], q[hit], grid_text[row[hit]]
        ahead, back = grammar.extension(i, i + q), grammar.extension(i - 1, i + q - 1, -1)
        good = (ahead + back >= q) & (ahead + back + q >= least)
        found.append(np.unique(np.stack([text, i - back - offsets[text], ahead + back + q, q])[:, good], axis=1))
    if not found:
        return tuple(np.empty(0, np.int64) for _ in range(4))
    text, start, length, q = np.concatenate(found, 1)
    order = np.lexsort((q, length, start, text))
    text, start, length, q = text[order], start[order], length[order], q[order]
    fresh = np.r_[True, (text[1:] != text[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])][:len(q)]
    text, start, length, q = text[fresh], start[fresh], length[fresh], q[fresh]
    order = np.lexsort((q, start, text))
    return text[order], start[order], length[order], q[order]


def repeats(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """Every row with ``runs`` (start, length, period; by start and period) and ``collapsed`` in place of its text.

    ``collapsed`` has the words that no run holds after its first period, joined by spaces.
    """
    kept = [f for f in docs.schema.fields if f.name not in (text, "runs", "collapsed")]
    names = [f.name for f in kept]
    one = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    schema = StructType(kept).add("runs", ArrayType(one)).add("collapsed", BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            words = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in part.column(text)]
            known: dict[bytes, int] = {}
            at, start, length, period = maximal_runs([np.array([known.setdefault(w, len(known)) for w in ws], np.int64) for ws in words], least)
            bounds = np.searchsorted(at, np.arange(len(words) + 1))
            collapsed = []
            for ws, low, high in zip(words, bounds, bounds[1:]):
                if low < high:
                    inside = np.zeros(len(ws) + 1, np.int64)
                    np.add.at(inside, start[low:high] + period[low:high], 1)
                    np.add.at(inside, start[low:high] + length[low:high], -1)
                    ws = [w for w, n in zip(ws, np.cumsum(inside).tolist()) if not n]
                collapsed.append(b" ".join(ws))
            found = pa.StructArray.from_arrays([pa.array(x) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([
                *[part.column(n) for n in names], pa.ListArray.from_arrays(bounds.astype(np.int32), found), pa.array(collapsed, pa.binary()),
            ], [*names, "runs", "collapsed"])

    whole = docs.select(*[f"`{n}`" for n in names], F.col(f"`{text}`").cast("binary").alias(text))
    return whole.mapInArrow(run, schema).withColumn("collapsed", F.col("collapsed").cast("string"))
