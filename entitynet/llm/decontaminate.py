"""Benchmark passages in training documents, found through a positional inverted index.

``build_index`` stores the postings of every training token: one row for each segment of
consecutive documents, with the sorted terms of the segment and, term by term, the
ascending places at which it stands. Places run on through a segment with a gap after each
document, so a phrase cannot cross two documents. ``search`` takes the benchmark in blocks
of bounded size. For each window of an item it starts from the rarest term of the segment,
shifts each list by the term's offset in the window and intersects on towards the
commoner ones: what is left are the exact occurrences. A proximity match needs all the
words of a window within ``near`` consecutive words of a document, in any order.

The index never leaves its segment: there is no shuffle of postings, and a segment is
bounded by ``SEGMENT_CHARS`` or, beyond it, one document. ``clean`` searches a segment's index
in the task that built it if the benchmark is one block; only one of several is stored for the
passes to come.

Defined cases: null and empty texts have no words, are never hit and name no item; repeated
documents keep a row each; rows of the benchmark with one id are one item; a null item id
counts as the empty string; without any item every document is clean.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitynet.llm.tables import give_back, slices, unused
from entitynet.session import cut, keep, scope

#: Bytes of text in a segment.
SEGMENT_CHARS = 3_000_000
#: Words of benchmark text that one pass over the index takes.
BLOCK_WORDS = 500_000

_UPPER = range(ord("A"), ord("Z") + 1)
_WORD = {*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)}
_FOLD = bytes(b + 32 if b in _UPPER else b if b in _WORD else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and characters beyond ASCII."""
    return (text or b"").translate(_FOLD).split()


def index_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The index of (doc_id, text) rows, a batch of one row for each segment, as in ``build_index``."""
    base = TaskContext.get().partitionId() << 33
    for i, part in enumerate(slices(batches, "text", SEGMENT_CHARS)):
        each = [words_of(x.as_buffer().to_pybytes() if x.is_valid else None) for x in part.column("text")]
        counts = np.array([len(x) for x in each], np.int64)
        first = np.r_[0, np.cumsum(counts + 1)[:-1]]
        coded = pa.array([w for x in each for w in x], pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        place = np.arange(len(codes)) + np.repeat(np.arange(len(each)), counts)
        order = np.argsort(codes, kind="stable")
        starts = np.r_[0, np.cumsum(np.bincount(codes, minlength=len(coded.dictionary)))]
        yield pa.RecordBatch.from_arrays([
            pa.array([base + i], pa.int64()), pa.array([part.column("doc_id").to_pylist()], pa.list_(part.column("doc_id").type)),
            pa.array([first], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())),
            pa.array([b" ".join(coded.dictionary.to_pylist())], pa.binary()),
            pa.array([starts.astype("<i4").tobytes()], pa.binary()), pa.array([place[order].astype("<i4").tobytes()], pa.binary()),
        ], ["segment", "doc_ids", "first", "words", "terms", "starts", "places"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def build_index(docs: DataFrame) -> DataFrame:
    """Rows (segment, doc_ids, first, words, terms, starts, places) over (doc_id, text), written out.

    ``first`` and ``words`` give each document's first place and number of words; ``terms``
    are joined by spaces; the list of term i is ``places[starts[i]:starts[i + 1]]``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut(_texts(docs).mapInArrow(
        index_segments, f"segment bigint, doc_ids array<{kind}>, first array<bigint>, words array<bigint>, terms binary, starts binary, places binary"))


def item_blocks(benchmark: DataFrame, window: int, limit: int = BLOCK_WORDS) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The items in blocks of (item_id, words) of at most ``limit`` words; a longer item is cut, no window is lost."""
    block, size = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).toLocalIterator():
        words = words_of(row.text)
        for k in range(0, max(len(words) - window + 1, 1), limit):
            piece = words[k:k + limit + window - 1]
            if block and size + len(piece) > limit:
                yield block
                block, size = [], 0
            if piece:
                block.append((row.item, piece))
                size += len(piece)
    yield block


def held(sorted_list: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the list has a value from low to high, for each pair."""
    return np.searchsorted(sorted_list, low, "left") < np.searchsorted(sorted_list, high, "right")


def within(lists: list[np.ndarray], low: int, high: int, near: int) -> bool:
    """Whether ``near`` consecutive places from low to high hold a place of every list."""
    found = sorted((int(p), k) for k, x in enumerate(lists) for p in x[np.searchsorted(x, low):np.searchsorted(x, high, "right")])
    last: dict[int, int] = {}
    for place, k in found:
        last[k] = place
        if len(last) == len(lists) and place - min(last.values()) < near:
            return True
    return False


def search_block(block: list[tuple[str, list[bytes]]], window: int, near: int, every: bool):
    """For each segment: a row for each document (only those with a match unless ``every``)."""
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(w for _, words in block for w in words))}
    text = np.array([vocabulary[w] for _, words in block for w in words], np.int64)
    ends = np.cumsum([len(words) for _, words in block], dtype=np.int64)
    spans = [(i, k, min(window, len(words))) for i, (_, words) in enumerate(block)
             for k in range(ends[i] - len(words), ends[i] - min(window, len(words)) + 1)]
    item, start, length = np.array(spans, np.int64).reshape(-1, 3).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for k in range(batch.num_rows):
                yield matches(batch.slice(k, 1).to_pylist()[0], batch.schema.field("doc_ids").type.value_type)

    def matches(row: dict, kind: pa.DataType) -> pa.RecordBatch:
        starts, places = np.frombuffer(row["starts"], "<i4"), np.frombuffer(row["places"], "<i4")
        first, counts = np.array(row["first"]), np.array(row["words"])
        code = np.full(len(vocabulary), -1, np.int64)
        for i, v in enumerate(map(vocabulary.get, row["terms"].split())):
            if v is not None:
                code[v] = i
        size = np.where(code >= 0, starts[code + 1] - starts[code], 0) if len(starts) > 1 else np.zeros(len(vocabulary), np.int64)
        absent = np.r_[0, np.cumsum(size[text] == 0)]
        exact: dict[int, list[tuple[int, int, int]]] = {}
        close: dict[int, set[int]] = {}
        for w in np.flatnonzero(absent[start + length] == absent[start]):
            terms = text[start[w]:start[w] + length[w]]
            listed = lambda t: places[starts[code[t]]:starts[code[t] + 1]]
            order = np.argsort(size[terms], kind="stable")
            at = listed(terms[order[0]]) - order[0]
            for k in order[1:]:
                if not len(at):
                    break
                at = at[held(listed(terms[k]), at + k, at + k)]
            for place, d in zip(at, np.searchsorted(first, at, "right") - 1):
                exact.setdefault(int(d), []).append((int(place - first[d]), int(place - first[d] + length[w]), int(item[w])))
            if near:
                lists = [listed(t) for t in dict.fromkeys(terms[order])]
                around = lists[0]
                for x in lists[1:]:
                    around = around[held(x, around - near + 1, around + near - 1)]
                for place, d in zip(around, np.searchsorted(first, around, "right") - 1):
                    low, high = max(first[d], place - near + 1), min(first[d] + counts[d] - 1, place + near - 1)
                    if item[w] not in close.get(int(d), ()) and within(lists, low, high, near):
                        close.setdefault(int(d), set()).add(int(item[w]))
        shown = range(len(first)) if every else sorted({*exact, *close})
        return pa.RecordBatch.from_arrays([
            pa.array([row["segment"]] * len(shown), pa.int64()), pa.array(list(shown), pa.int32()),
            pa.array([row["doc_ids"][d] for d in shown], kind), pa.array(counts[list(shown)], pa.int64()),
            pa.array([merged(exact.get(d, ())) for d in shown], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))),
            pa.array([sorted({block[i][0] for *_, i in exact.get(d, ())}) for d in shown], pa.list_(pa.string())),
            pa.array([sorted({block[i][0] for i in close.get(d, ())}) for d in shown], pa.list_(pa.string())),
        ], ["segment", "ordinal", "doc_id", "n_words", "spans", "items", "near_items"])

    return run


def merged(spans) -> list[dict[str, int]]:
    """Disjoint spans of the words in any of ``spans``."""
    out: list[dict[str, int]] = []
    for a, b, _ in sorted(spans):
        if out and a <= out[-1]["b"]:
            out[-1]["b"] = max(b, out[-1]["b"])
        else:
            out.append({"a": a, "b": b})
    return out


def _found(kind: str) -> str:
    return (f"segment bigint, ordinal int, doc_id {kind}, n_words bigint, spans array<struct<a: bigint, b: bigint>>, "
            "items array<string>, near_items array<string>")


def search(index: DataFrame, benchmark: DataFrame, window: int = 10, near: int = 0) -> DataFrame:
    """doc_id, n_words, spans (word spans that are hit), items, near_items of every indexed document."""
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    found = None
    for i, block in enumerate(item_blocks(benchmark, window)):
        part = cut(index.mapInArrow(search_block(block, window, near, i == 0), _found(kind)))
        found = part if found is None else found.unionByName(part)
    together = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    return found.groupBy("segment", "ordinal", "doc_id", "n_words").agg(*map(together, ("spans", "items", "near_items"))).drop("segment", "ordinal")


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, near: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and n_near (items with a proximity match) of every document."""
    found = search(build_index(docs), benchmark, window, near)
    covered = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")), lambda s, x: F.struct(
        F.greatest(s.end, x.b).alias("end"), (s.n + F.greatest(F.lit(0).cast("long"), x.b - F.greatest(s.end, x.a))).alias("n")))
    return found.select(
        "doc_id", "n_words", covered.n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The doc_id of every row of (doc_id, text) with an occurrence of a window of an item."""
    blocks = [*islice(item_blocks(benchmark, window), 2)]
    if len(blocks) > 1:
        found = search(build_index(docs), benchmark, window)
    else:
        find = search_block(blocks[0], window, 0, False)
        found = _texts(docs).mapInArrow(lambda batches: find(index_segments(batches)), _found(docs.schema["doc_id"].dataType.simpleString()))
    return found.where(F.size("spans") > 0).select("doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any occurrence of a window of an item; every column is kept, whatever its name.

    Rows are numbered in a written table, so that a row goes for its own text alone,
    whatever other rows share its id or have none.
    """
    row = unused(docs, "_row")
    numbered = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    with scope():
        found = hits(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, window)
        hit = keep(cut(found.select(F.col("doc_id").alias(row)).distinct()))
    return numbered.join(hit, row, "left_anti").select(*[f"`{c}`" for c in docs.columns])
