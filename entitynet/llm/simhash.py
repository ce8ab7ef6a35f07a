"""Near-duplicate documents by 64-bit SimHash fingerprints, joined on pigeonhole blocks.

Two fingerprints that differ in at most ``distance`` bits agree on all of the bits of at
least ``blocks - distance`` of ``blocks`` blocks, whichever those are. Every distinct
fingerprint is filed once under each choice of that many blocks, and only fingerprints in
the same file are compared. The number of blocks follows the number of distinct
fingerprints, so that files of unrelated fingerprints stay short; it never changes a result.

Inside a file the links are reduced to a spanning forest, so that a group of near copies
gives one edge a member and not one a pair. A file of more than ``LARGEST`` members is not
compared in one task: its members are filed under every value within ``distance / 2`` bits
of themselves, and two of them are within ``distance`` exactly if they share such a value.

Defined cases: null or empty texts and texts of white space have fingerprint 0 and are
linked like any other; a text of one to three words is one shingle; repeated ids and
repeated rows each keep a row; null ids are passed over in the choice of the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitynet.llm.components import components
from entitynet.llm.tables import slices
from entitynet.session import cut

BITS = 64
#: Members of a file that one task compares.
LARGEST = 20_000
#: Shingles whose bits are counted at once.
CHUNK = 100_000


def fingerprint(text: bytes | None, words_each: int, seed: int) -> int:
    """The SimHash of the shingles of ``text``: a bit is set if over half of the hashes have it."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [n + i for i, n in enumerate(accumulate(map(len, words)))]
    starts = [0, *(end + 1 for end in ends[:-1])]
    ends = ends[words_each - 1:] or ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(ends), CHUNK):
        hashes = np.array([digest(joined[i:j], seed) for i, j in zip(starts[k:k + CHUNK], ends[k:k + CHUNK])], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(ends), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words_each: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``, fp as a signed 64-bit number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            made = [fingerprint(x.as_buffer().to_pybytes() if x.is_valid else None, words_each, seed) for x in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp bigint")


def choices(count: int, distance: int) -> list[int]:
    """Masks of the block choices: the fewest blocks whose shortest choice has two bits more than ``count`` needs."""
    for blocks in range(distance + 1, BITS + 1):
        cuts = [BITS * i // blocks for i in range(blocks + 1)]
        masks = [((1 << (j - i)) - 1) << i for i, j in zip(cuts, cuts[1:])]
        keys = [sum(c) for c in combinations(masks, blocks - distance)]
        if min(k.bit_count() for k in keys) >= count.bit_length() + 2 or blocks == distance + 5:
            return keys
    raise ValueError(f"no choice of blocks for distance {distance}")


def signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def forest(members: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    edges, rest = [], members
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            one = queue.pop()
            near = np.bitwise_count((rest ^ one).view("<u8")) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                edges += [(int(one), int(x)) for x in found]
                queue += list(found)
    return edges


def compare(distance: int, largest: int):
    """For rows sorted by (choice, key): forest edges (a, b) of every file, or (member, null) of a file too large."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, large = [], None, False
        out: list[tuple[int, int | None]] = []

        def close() -> None:
            if not large and sum(map(len, held)) > 1:
                out.extend(forest(np.concatenate(held), distance))

        for batch in batches:
            if not batch.num_rows:
                continue
            choice, key, fp = (batch.column(n).to_numpy() for n in ("choice", "key", "fp"))
            starts = np.flatnonzero(np.r_[True, (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])])
            ends = np.r_[starts[1:], len(fp)]
            more = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(fp)))
            for i, j in zip(starts[more], ends[more]):
                if (choice[i], key[i]) != at:
                    close()
                    held, at, large = [], (choice[i], key[i]), False
                held.append(fp[i:j])
                if large or sum(map(len, held)) > largest:
                    out.extend((int(x), None) for part in held for x in part)
                    held, large = [], True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def links(distinct: DataFrame, count: int, distance: int = 4, largest: int = LARGEST) -> DataFrame:
    """(a, b) edges that connect the column ``fp`` of distinct fingerprints as all links do."""
    filed = distinct.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(signed(mask)).alias("key"))
        for i, mask in enumerate(choices(count, distance))])).alias("file")).select("file.choice", "file.key", "fp")
    found = cut(filed.repartition("choice", "key").sortWithinPartitions("choice", "key").mapInArrow(compare(distance, largest), "a bigint, b bigint"))
    crowded = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    if crowded.isEmpty():
        return found
    if distance % 2:
        raise ValueError("files that large are handled for even distances")
    near = [signed(sum(1 << i for i in bits)) for n in range(distance // 2 + 1) for bits in combinations(range(BITS), n)]
    around = cut(crowded.select("fp", F.explode(F.array(*map(F.lit, near))).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("at")))
    least = cut(around.groupBy("at").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"))
    return found.where("b is not null").unionByName(around.join(least, "at").where("fp != b").select(F.col("fp").alias("a"), "b").distinct())


def classes(docs: DataFrame, words_each: int = 4, distance: int = 4, largest: int = LARGEST) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable) of every document.

    Text is read once and never shuffled; exact copies meet as one fingerprint before any
    comparison.
    """
    each = cut(fingerprints(docs.select("doc_id", "text"), words_each))
    distinct = cut(each.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, distinct.count(), distance, largest)).withColumnRenamed("node", "fp")
    labelled = cut(distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")))
    least = cut(labelled.groupBy("root").agg(F.min("first").alias("component_id")))
    named = cut(labelled.join(least, "root").select("fp", "component_id"))
    return each.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The documents without near copies: of each class the one with the smallest id, null ids last.

    A row of the same class that repeats the kept id is kept as well; of a class without
    ids one row stays. Rows are numbered in a written table and judged each by its own class.
    """
    numbered = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    rows = classes(numbered.select(F.col("_row").alias("doc_id"), "text"), **options).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class"))
    each = cut(numbered.select("_row", "doc_id").join(rows, "_row"))
    least = cut(each.groupBy("_class").agg(F.min("doc_id").alias("_id"), F.min("_row").alias("_first")))
    keep = cut(each.join(least, "_class").where((F.col("doc_id") == F.col("_id")) | (F.col("_id").isNull() & (F.col("_row") == F.col("_first")))).select("_row"))
    return numbered.join(keep, "_row", "left_semi").select(*[f"`{c}`" for c in docs.columns])
