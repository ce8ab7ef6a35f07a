"""Reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered 0 to N-1 in the order of their sort columns, the number is permuted by a
keyed Feistel network over the next power of two, and a value that falls outside N is
permuted again until it falls inside (cycle walking). The permuted number ``p`` gives
shard ``p % shards`` and slot ``p // shards``, so shard sizes differ by one at most and
the place of a row follows from its number, and the number from its place, without a lookup.

Defined cases: an empty table gives no rows; rows that agree in every sort column are
interchangeable; null sort values come first; a null text counts as no bytes.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from entitynet.session import cut

ROUNDS = 8
#: Passes of the network that one row may need: its value stays outside N with a chance below one half each time.
PASSES = 100
PRIME = 2**31 - 1


def round_constants(key: str, rounds: int = ROUNDS) -> list[tuple[int, int]]:
    """Two numbers below PRIME for each round, drawn from the key."""
    digests = [hashlib.sha256(f"{key}/{i}".encode()).digest() for i in range(rounds)]
    return [(int.from_bytes(d[:8], "big") % PRIME, int.from_bytes(d[8:16], "big") % PRIME) for d in digests]


def widths(rows: int) -> tuple[int, int]:
    """Bits of the low and of the high half: together the fewest that hold ``rows`` values, two at least."""
    bits = max(2, (rows - 1).bit_length())
    if bits > 62:
        raise ValueError(f"{rows} rows are more than the permutation can number")
    return bits // 2, bits - bits // 2


def permute(number: Column, rows: int, key: str, inverse: bool = False) -> Column:
    """``number`` (0 to rows-1) permuted among 0 to rows-1; ``inverse`` undoes it.

    One step of the fold is one round: even rounds change the high half, odd rounds the
    low one. Round values are squares modulo a prime, which every SQL engine computes alike.
    """
    low_bits, high_bits = widths(rows)
    order = list(enumerate(round_constants(key)))[:: -1 if inverse else 1]
    table = F.array(*[F.struct(F.lit(i % 2).alias("odd"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"))
                      for i, (a, b) in order])
    value = lambda s: s.high * F.lit(1 << low_bits) + s.low

    def step(state: Column, i: Column) -> Column:
        c = F.element_at(table, i + 1)
        mixed = lambda x: (((x + c.a) % PRIME) * ((x + c.a) % PRIME) + c.b) % PRIME
        odd = c.odd == 1
        high = F.when(odd, state.high).otherwise(state.high.bitwiseXOR(mixed(mixed(state.low)).bitwiseAND((1 << high_bits) - 1)))
        low = F.when(odd, state.low.bitwiseXOR(mixed(mixed(state.high)).bitwiseAND((1 << low_bits) - 1))).otherwise(state.low)
        return F.struct(high.alias("high"), low.alias("low"))

    start = F.struct(F.shiftright(number, low_bits).alias("high"), number.bitwiseAND((1 << low_bits) - 1).alias("low"))
    passes = min(PASSES, (1 << (low_bits + high_bits)) - rows + 1)
    walk = F.aggregate(
        F.sequence(F.lit(0), F.lit(passes - 1)), start,
        lambda state, p: F.when((p > 0) & (value(state) < rows), state).otherwise(
            F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), state, step)))
    out = value(walk)
    return F.when(out < rows, out).otherwise(F.raise_error(F.lit("cycle walking did not end")).cast("long"))


def number_rows(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """``df`` with ``row`` from 0 in the order of the columns, and the number of rows.

    Range partitions are sorted on their own and shifted by the sizes of those before them;
    rows equal in every column are spread over partitions by their place in the input. The
    sorted table is written out, so a lost executor cannot number a row anew.
    """
    keys = [*order, "_at"]
    placed = cut(df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
                 .withColumn("_part", F.spark_partition_id())
                 .withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = counts.select("_part", (F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")).alias("_before"))
    rows = placed.count()
    return placed.join(before, "_part").withColumn("row", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before"), rows


def assign(docs: DataFrame, shards: int = 8, key: str = "shuffle-1") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, by the law ``rows``.

    Only the id and three numbers of each text are shuffled. Equal texts are spread like
    any other rows: with counts at most one apart, a group of copies cannot share a shard.
    """
    data = F.encode(F.col("text"), "UTF-8")
    narrow = docs.select(
        "doc_id", (F.coalesce(F.octet_length(data), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(data, F.lit(b""))).alias("text_crc32"), F.xxhash64("text").alias("_hash"))
    numbered, rows = number_rows(narrow, "doc_id", "size", "text_crc32", "_hash")
    place = permute(F.col("row"), max(rows, 1), key)
    return numbered.select("*", place.alias("_place")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("_place", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def row_at(shard: Column, slot: Column, rows: int, shards: int = 8, key: str = "shuffle-1") -> Column:
    """The global row number that stands at ``slot`` of ``shard``."""
    return permute(slot * shards + shard, rows, key, inverse=True)
