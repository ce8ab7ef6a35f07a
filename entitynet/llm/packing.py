"""Packing of tokenised documents into sequences by first-fit decreasing.

Each document becomes the tokenizer's ids and an end id, cut into pieces of one sequence
length and a rest. Pieces are dealt at random into groups of bounded expected size; each
group is packed on its own by first-fit decreasing: pieces in falling length, each into the
first sequence with room for it, found by walking down a tournament tree of the room left.
Only the numbers of a piece are shuffled; its ids stay with the text, or travel along with
``keep_ids``.

Defined cases: null and empty texts give one piece, the end id alone; repeated documents
are packed each; an empty table gives no rows; a text of any length is cut, never cut off.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from entitynet.llm.tables import slices
from entitynet.session import cut

#: Pieces that a group is expected to hold.
GROUP_PIECES = 20_000
#: Words whose ids a worker remembers.
KNOWN_WORDS = 300_000
#: Bytes of text that a task splits at once.
SPLIT_CHARS = 750_000


class Tokens:
    """The ids of a tokenizer of lower-cased words, with a memory of words seen.

    Texts of plain Latin letters are split as the tokenizer splits them and looked up word
    by word, which gives the same ids: a word's ids do not depend on its neighbours. Every
    other text goes to the tokenizer whole.
    """

    #: Printable ASCII, line ends, tabs and Latin letters that no normal form or case rule joins to a neighbour.
    PLAIN = re.compile("[\t\n\r -~\xa1-\xac\xae-\xffĀ-įı-ňŊ-ž]*")
    #: Of each plain lower-case character: a space, part of a word of letters, a word of its own (digits), part of a word of the others.
    SPACE, LETTER, DIGIT, OTHER = range(4)
    KIND = np.array([0 if c in "\t\n\r " else 1 if re.match("[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ſ]", c) else 2 if c in "0123456789\xb2\xb3\xb9\xbc\xbd\xbe" else 3
                     for c in map(chr, range(0x180))], np.int8)

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task a core
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # Words of plain texts are lower-cased and split already: the same merges, without those steps.
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        """Encode the words as one text; the ids of a word end with one that closes a word."""
        text = [" ".join(words[i:i + 2000]) for i in range(0, len(words), 2000)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.speller.encode_batch_fast(text, add_special_tokens=False)])
        ends = np.flatnonzero(self.closes[ids]) + 1
        if len(ends) != len(words) or ends[-1] != len(ids):
            raise ValueError("the tokenizer does not close every word")
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words))))
        self.starts = np.concatenate([self.starts, self.starts[-1] + ends])
        self.ids = np.concatenate([self.ids, ids])

    def words(self, texts: list[str]) -> tuple[pa.StringArray, np.ndarray]:
        """The words of plain texts, as the tokenizer's pattern finds them, and the number of words before each text."""
        text = "\n".join(texts).lower()
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        kind = self.KIND[code]
        starts = (kind != np.r_[np.int8(self.SPACE), kind[:-1]]) & (kind != self.SPACE) | (kind == self.DIGIT)
        # An apostrophe that begins a word takes s, t, m, d, re, ve or ll with it, and what follows is a word of its own.
        marks = np.flatnonzero((code == ord("'")) & starts)
        after = np.r_[code, np.zeros(3, np.uint32)]
        one, two = after[marks + 1], after[marks + 2]
        taken = np.select([np.isin(one, [*map(ord, "stmd")]), np.isin(one, [*map(ord, "rv")]) & (two == ord("e")), (one == ord("l")) & (two == one)], [1, 2, 2], 0)
        marks, taken = marks[taken > 0], taken[taken > 0]
        starts[marks + 1] = False
        ends = marks + taken + 1
        starts[(ends := ends[ends < len(kind)])[kind[ends] == self.LETTER]] = True
        # Words lie end to end once the spaces are out; no plain character takes more than two bytes.
        size = np.where(kind == self.SPACE, 0, np.where(code < 0x80, 1, 2)).astype(np.int32)
        before = np.cumsum(size, dtype=np.int32) - size
        data = np.frombuffer(text.encode(), np.uint8)
        data = data[data > 32]
        offsets = np.r_[before[starts], np.int32(len(data))].astype(np.int32)
        found = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        return found, np.r_[0, np.cumsum(starts)][np.cumsum([0, *[len(t) + 1 for t in texts]])[:-1]]

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        plain = [bool(self.PLAIN.fullmatch(t)) and "<|" not in t for t in texts]
        words, firsts = self.words([t if p else "" for t, p in zip(texts, plain)])
        coded = words.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(at < 0)):
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.learn([distinct[i] for i in new])
        at = at[coded.indices.to_numpy()]
        lengths = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(lengths)
        ids = self.ids[np.repeat(self.starts[at] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.r_[0, ends][np.r_[firsts, len(words)]]
        return [ids[bounds[i]:bounds[i + 1]] if p else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                for i, (t, p) in enumerate(zip(texts, plain))]


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """The worker's ``Tokens``, which its tasks share: a task neither loads the tokenizer again nor learns known words anew."""
    return Tokens(path)


def pieces(docs: DataFrame, path: str, end_id: int, length: int, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for part in slices(batches, "text", SPLIT_CHARS):
            columns: list[list] = [[] for _ in names]
            for doc_id, ids in zip(part.column("doc_id").to_pylist(), tokens.of([t or "" for t in part.column("text").to_pylist()])):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                for k in range(0, len(ids), length):
                    piece = ids[k:k + length]
                    row = (doc_id, k, len(piece), zlib.crc32(piece.tobytes()), len(ids), *[piece.astype(np.int64)] * keep_ids)
                    for c, v in zip(columns, row):
                        c.append(v)
            types = [part.column("doc_id").type, *[pa.int64()] * 4, *[pa.list_(pa.int64())] * keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<bigint>" * keep_ids)


def first_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each size, the sizes in falling order: each goes to the first bin with room for it.

    A node of the tree holds the most room below it; the leaves are the bins in order.
    """
    leaves = 1 << max(len(sizes) - 1, 1).bit_length()
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return bins, offsets


def pack(docs: DataFrame, path: str, end_id: int = 2, length: int = 4096, seed: int = 17, group_pieces: int = GROUP_PIECES,
         keep_ids: bool = False) -> DataFrame:
    """The pieces of all documents with sequence_id and offset; sequences hold ``length`` ids at most."""
    made = cut(pieces(docs, path, end_id, length, keep_ids).withColumn("_row", F.monotonically_increasing_id()))
    groups = -(-made.count() // group_pieces) or 1

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "_row"], ascending=[False, True], kind="stable")
        bins, offsets = first_fit(frame["length"].to_numpy(), length)
        return frame.assign(sequence_id=frame["_group"] * 2**32 + bins, offset=offsets).drop(columns=["_group", "_row"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema if f.name != "_row")
    dealt = made.withColumn("_group", F.pmod(F.xxhash64("_row", F.lit(seed)), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(packed, f"{kept}, sequence_id bigint, offset bigint")
