"""Substring dedup: whole windows around recurring winnowed anchors are hashed and counted, repeated ones removed.

This replaces joining documents on anchors and extending matches both ways, which costs the square of a hot
passage's copies; overlapping repeated windows make up the same longer repeats.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import NOT_BLANK, RollingHash, joined, lean, mixed, needs, slices, utf8, word_hashes, words_at

#: Words of an anchor. A window of `length` words holds length - ANCHOR + 1 of them and selects the least.
ANCHOR = 8
SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])


class Words:
    """Word hashes of a slice of texts, with the anchor that each window selects."""

    def __init__(self, column: pa.Array, length: int, rolls: tuple[RollingHash, RollingHash]):
        anchor = min(ANCHOR, length)
        buffer, ends = joined(column)
        begin, end, self.first = words_at(buffer, ends, NOT_BLANK)
        self.length = length
        n = len(begin)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        start = np.arange(max(0, n - length + 1))
        #: First word of every window, in words of the slice, and its text.
        self.start = start[text[start] == text[start + length - 1]]
        self.text = text[self.start]
        #: Two sums over two hashes of each word, so that no pair of words is equal in both.
        self.sums = [r.sums(word_hashes(buffer, begin, end, 21 + k)) for k, r in enumerate(rolls)]
        self.rolls = rolls
        self.anchor_hash = self.rolls[0].spans(self.sums[0], np.arange(n - anchor + 1), np.arange(anchor, n + 1)) if n >= anchor else np.zeros(0, np.uint64)
        #: The word at which the anchor of each window begins: the first of the least.
        self.anchor = self.start.copy()
        for i in range(0, len(self.start), 1 << 16):
            part = self.start[i : i + (1 << 16)]
            self.anchor[i : i + (1 << 16)] += sliding_window_view(self.anchor_hash, length - anchor + 1)[part].argmin(axis=1)

    def window_hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of hash for the chosen windows."""
        start = self.start[chosen]
        one, two = (r.spans(s, start, start + self.length) for r, s in zip(self.rolls, self.sums, strict=True))
        return one.view(np.int64), (mixed(two) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def marked(self, lists: pa.Array) -> np.ndarray:
        """For each word of the slice whether it is in its text's list of word numbers; null is an empty list."""
        out = np.zeros(int(self.first[-1]), dtype=bool)
        size = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], dtype=np.int64)
        out[lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(self.first[:-1], size)] = True
        return out


def rolls() -> tuple[RollingHash, RollingHash]:
    if not hasattr(rolls, "kept"):
        rolls.kept = (RollingHash(22), RollingHash(23))
    return rolls.kept


def rows_of(batch: pa.RecordBatch, values: list[np.ndarray], names: list[str], text: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One row for each value: its hash columns, the id and hash of its text, and its word number in the text."""
    return pa.RecordBatch.from_arrays([*map(pa.array, values), batch.column("doc_id").take(pa.array(text)), batch.column("_row").take(pa.array(text)), pa.array(place.astype(np.int32))], names=[*names, "doc_id", "_row", "at"])


def anchors(keyed: DataFrame, length: int) -> DataFrame:
    """(anchor, doc_id, _row, at): each anchor that a window selects, once for each place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), length, rolls())
            chosen = np.flatnonzero(np.diff(w.anchor, prepend=-1))  # anchors of later windows never lie before
            at, text = w.anchor[chosen], w.text[chosen]
            yield rows_of(batch, [w.anchor_hash[at].view(np.int64)], ["anchor"], text, at - w.first[text])

    kind = T.StructType([T.StructField("anchor", T.LongType()), keyed.schema["doc_id"], keyed.schema["_row"], T.StructField("at", T.IntegerType())])
    return keyed.mapInArrow(lean(run), kind)


def windows(listed: DataFrame, length: int) -> DataFrame:
    """(w1, w2, doc_id, _row, at): the windows whose anchor also occurs elsewhere (is not in lone_anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), length, rolls())
            chosen = np.flatnonzero(~w.marked(batch.column("lone_anchors"))[w.anchor])
            text = w.text[chosen]
            yield rows_of(batch, [*w.window_hashes(chosen)], ["w1", "w2"], text, w.start[chosen] - w.first[text])

    kind = T.StructType([T.StructField("w1", T.LongType()), T.StructField("w2", T.IntegerType()), listed.schema["doc_id"], listed.schema["_row"], T.StructField("at", T.IntegerType())])
    return listed.mapInArrow(lean(run), kind)


def lone(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(doc_id, _row, name): for each document the places of values that no other row has.

    Values that occur twice or more drop out, so however many places a value has, it costs a row a task;
    of a value with one row the minima are that row.
    """
    once = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(c) for c in ("doc_id", "_row", "at")])
    return once.where("n = 1").groupBy("doc_id", "_row").agg(F.collect_list("at").alias(name))


def with_list(docs: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """docs with the list of each document; the shuffle of docs is the same each time, so Spark runs it once."""
    right = lists.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_hash"), name).hint("shuffle_hash")
    return docs.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash")), "left").drop("_id", "_hash")


def repeats(docs: DataFrame, length: int = 35) -> DataFrame:
    """(doc_id, text, n_words, n_removed, kept, removed) for each row of docs.

    Words are runs of other than ASCII blanks, unchanged. A window is `length` consecutive words of one
    text; every word that lies in a window whose words also start anywhere else, in the same text or another,
    is removed: no copy stays. removed lists the maximal repeats as [begin, end) word numbers and kept is the other words, joined by
    one space. A null text has no words. Rows are told apart by place, so of two equal rows each is the
    other's copy. Fewer words than `length` make no window. Texts of any length are read whole, an empty table stays
    empty, other columns are dropped. length is under 1,024, beyond which hashes of windows could cancel out.

    Seeds are winnowed anchors: each window selects its least ANCHOR-word hash, so equal windows select
    equal anchors. Only windows around an anchor that occurs elsewhere are extended: hashed whole and
    compared. Groups are only counted, never listed; what is sent back to a document is its own lone places.
    """
    needs(docs, "doc_id", "text")
    if not 0 < length < 1024:
        raise ValueError(f"length {length}: 1 to 1,023 words")
    # The hash of the text tells rows with one doc_id apart; where ids are unique it is left out.
    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    key = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) if twice else F.lit(0).cast("long")
    keyed = docs.select("doc_id", "text", key.alias("_row"))
    first = with_list(keyed, lone(anchors(keyed, length), ["anchor"], "lone_anchors"), "lone_anchors")
    both = with_list(first, lone(windows(first, length), ["w1", "w2"], "lone_windows"), "lone_windows")
    kinds = [("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept", T.StringType()), ("removed", T.ArrayType(SPAN))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            w = Words(batch.column("text"), length, rolls())
            found = w.start[~w.marked(batch.column("lone_anchors"))[w.anchor] & ~w.marked(batch.column("lone_windows"))[w.start]]
            edge = np.zeros(int(w.first[-1]) + 1, dtype=np.int64)
            edge[found] += 1
            np.subtract.at(edge, found + length, 1)
            gone = np.cumsum(edge)[:-1] > 0
            count = np.concatenate([[0], np.cumsum(gone)])
            removed = count[w.first[1:]] - count[w.first[:-1]]
            kept, spans = [], []
            for i, text in enumerate(utf8(batch.column("text"))):
                words = text.split()
                mine = gone[w.first[i] : w.first[i + 1]]
                if removed[i]:
                    words = compress(words, (~mine).tolist())
                    turns = np.flatnonzero(np.diff(mine.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
                else:
                    turns = ()
                kept.append(b" ".join(words))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in turns])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text"), pa.array(np.diff(w.first)), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))],
                names=["doc_id", "text", *[n for n, _ in kinds]],
            )

    out = T.StructType([keyed.schema["doc_id"], keyed.schema["text"], *[T.StructField(n, t) for n, t in kinds]])
    return both.mapInArrow(lean(run), out)
