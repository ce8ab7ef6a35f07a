"""Product-quantisation codes of vectors, trained and assigned in whole numbers only.

Components become integers, a vector is cut into equal consecutive parts, and every part
position has a codebook, trained by rounds of assignment and averaging over all vectors.
The nearest entry is found in the Walsh-Hadamard domain: the integer transform of a part,
padded with zeros to a power of two D, keeps every squared distance but for the factor D.
Squared differences are summed from the lowest sequency on, where most of the energy of a
part lies, and an entry is out as soon as its sum exceeds the whole distance to the entry
that looked nearest at first. A sum of some squares never exceeds that of all, so the result is
exact. Batches whose values 64 bits might not hold are worked on in Python's integers.

A round reads the vectors once; only the sums of each entry's parts, 2 numbers a component
of the codebooks, leave a task and reach the driver. The codebooks have ``entries`` x
dimension numbers whatever the rows.

Defined cases: a vector that is null or holds a null, NaN or infinite component takes no
part and has no row; ids order the first entries, null ids last, rows of one id by their
vectors; fewer vectors than entries make smaller codebooks; no vector at all gives no rows
and empty codebooks; vectors of unlike length, or of a length that the parts do not divide,
are an error. ``encode`` keeps the input's other columns; one named like a result gives way
to it. The nearest of equally near entries is the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, IntegerType, StructType

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096

Books = list[np.ndarray]


def usable(vector: str) -> Column:
    """Whether the array ``vector`` is there and all its components are finite numbers."""
    x = F.col(vector)
    finite = (F.array_max(x) < float("inf")) & (F.array_min(x) > float("-inf")) & (F.size(F.array_compact(x)) == F.size(x))
    return x.isNotNull() & ((F.size(x) == 0) | F.coalesce(finite, F.lit(False)))


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles, in 64 bits where they suffice for distances."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values.astype(np.float64) * scale)
    if not scaled.size or np.abs(scaled).max() < 2.0 ** 40:
        return scaled.astype(np.int64)
    exact = [floor(x * scale) if abs(x) < 2.0 ** 53 else int(x) * scale for x in values.astype(np.float64).ravel().tolist()]
    return np.array(exact, dtype=object).reshape(values.shape)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of ``column`` as rows of one matrix."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"vectors of unlike length: {width} and {lengths[lengths != width][0]}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def walsh(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of the rows of ``x``, padded to a power of two, in sequency order."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    y = np.zeros((len(x), size), x.dtype)
    y[:, :x.shape[1]] = x
    at = np.arange(size)
    # A row of the Hadamard matrix changes sign as often as the Gray code of its reversed index counts.
    changes = np.zeros(size, np.int64)
    half = 1
    while half < size:
        z = y.reshape(len(x), -1, 2, half)
        y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(x), size)
        changes = changes * 2 + ((at // half) & 1)
        half *= 2
    for shift in (1, 2, 4, 8, 16, 32):
        changes ^= changes >> shift
    return y[:, np.argsort(changes)]


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and squared distance for each row of ``x``."""
    size = 1 << max(x.shape[1] - 1, 0).bit_length()
    largest = max((int(np.abs(a).max()) for a in (x, entries) if a.size), default=0)
    if size * (2 * size * largest) ** 2 >= 1 << 63:
        x, entries = x.astype(object), entries.astype(object)
    spectra, of = walsh(x), walsh(entries)
    first = (spectra[:, :1] - of[:, 0]) ** 2
    guess = np.argmin(first, 1)
    bound = ((spectra - of[guess]) ** 2).sum(1)
    row, entry = np.nonzero(first <= bound[:, None])
    total = first[row, entry]
    for k in range(1, size):
        total = total + (spectra[row, k] - of[entry, k]) ** 2
        stays = np.asarray(total <= bound[row], bool)
        row, entry, total = row[stays], entry[stays], total[stays]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(total, starts) if len(row) else total
    at = np.flatnonzero(np.asarray(total == least[row], bool))
    at = at[np.r_[True, row[at][1:] != row[at][:-1]]] if len(at) else at
    return entry[at], least // size


def split(x: np.ndarray, parts: int) -> list[np.ndarray]:
    width = x.shape[1] // parts
    return [x[:, i * width:(i + 1) * width] for i in range(parts)]


def averaged(vectors: DataFrame, vector: str, books: Books, width: int, scale: int) -> Books:
    """The codebooks after one round of assignment and averaging; an entry without parts stays."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for i, x in enumerate(split(integers(matrix(batch.column(0), width), scale), parts)):
                code, _ = nearest(x, books[i])
                for e in np.unique(code):
                    mine = x[code == e]
                    sums[i][e] += mine.sum(0).astype(object)
                    counts[i][e] += len(mine)
        rows = [(i, int(e), k, Decimal(int(sums[i][e, k])), int(counts[i][e]))
                for i in range(parts) for e in np.flatnonzero(counts[i]) for k in range(sums[i].shape[1])]
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["part", "entry", "at", "total", "n"])

    found = vectors.where(usable(vector)).select(vector).mapInArrow(run, "part int, entry int, at int, total decimal(38,0), n bigint")
    new = [b.astype(object) for b in books]
    for r in found.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        new[r.part][r.entry, r.at] = int(r.total) // r.n
    return [narrow(b) for b in new]


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 1 << 62 else x


def train(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS, scale: int = SCALE) -> Books:
    """One codebook of integers (entries x width) for each part position, from the vectors of the smallest ids."""
    first = vectors.where(usable(vector)).select(F.col(order).alias("k"), F.col(vector).alias("v")).orderBy(
        F.col("k").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return [np.zeros((0, 0), np.int64) for _ in range(parts)]
    width = len(first[0].v)
    if width % parts:
        raise ValueError(f"{parts} parts do not divide vectors of length {width}")
    if any(len(r.v) != width for r in first):
        raise ValueError("vectors of unlike length")
    books = [narrow(b) for b in split(integers(np.array([r.v for r in first], np.float64).reshape(len(first), width), scale), parts)]
    for _ in range(rounds):
        books = averaged(vectors, vector, books, width, scale)
    return books


def encode(vectors: DataFrame, books: Books, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Every usable vector's row with ``code`` (an entry's index for each part) and ``error`` (squared distance)."""
    parts, width = len(books), sum(b.shape[1] for b in books)
    kept = [f for f in vectors.schema.fields if f.name not in ("code", "error")]
    names = [f.name for f in kept]
    at = names.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(matrix(batch.column(at), width), scale)
            found = [nearest(p, b) for p, b in zip(split(x, parts), books)]
            codes = np.stack([c for c, _ in found], 1).astype(np.int32)
            error = sum(d.astype(object) for _, d in found)
            yield pa.RecordBatch.from_arrays([
                *batch.columns,
                pa.ListArray.from_arrays(np.arange(0, codes.size + 1, parts, dtype=np.int32), codes.ravel()),
                pa.array([Decimal(int(e)) for e in error], pa.decimal128(38, 0)),
            ], [*names, "code", "error"])

    schema = StructType(kept).add("code", ArrayType(IntegerType())).add("error", DecimalType(38, 0))
    return vectors.where(usable(vector)).select(*[f"`{n}`" for n in names]).mapInArrow(run, schema)


def digest(books: Books) -> str:
    """sha256 of all components, by part, entry and position, in decimal and with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for x in b.ravel()).encode()).hexdigest()
