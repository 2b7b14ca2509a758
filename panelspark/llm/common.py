"""Shared helpers: written intermediate tables, Arrow slices, row keys, components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.sources.shared import shared_folder, written  # noqa: F401

#: Bytes of text that a Python worker looks at together.
SLICE_BYTES = 4 << 20


#: Rows that one task of a small table takes.
TASK_ROWS = 200_000


def small(table: DataFrame) -> DataFrame:
    """A written table in as few partitions as its rows need: a row count of Parquet reads no rows."""
    return table.coalesce(1 + table.count() // TASK_ROWS)


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less its columns of these names in any case: what an operator adds replaces what was there."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def needs(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def row_key() -> list:
    """Columns that name a row: doc_id and a hash of its text. Rows equal in both are one document."""
    return [F.col("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("_row")]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches of about `limit` bytes of `column`; a longer text comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def lean(run):
    """run, for mapInArrow, which gives unused memory back when its task ends: workers outlive tasks, and what idle
    ones hold is missing to the executor."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return ended


def utf8(column: pa.Array) -> list[bytes]:
    """Bytes of each text; b"" for null."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts of the column in one byte array, and where each begins (one more entry than texts)."""
    texts = utf8(column)
    ends = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(x) for x in texts], out=ends[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), ends


def fields(df: DataFrame, *added: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*df.schema.fields, *[T.StructField(n, t, True) for n, t in added]])


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes whose values are mixed together.
MIXED_BYTES = 1 << 18


def word_hashes(values: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64 bits for each word [begin, end) of the byte values: the sum of a random number for each byte at its place in the word.

    Every pair of byte and place has its own number, so no pattern of bytes, such as a word and its complement, cancels out
    as in polynomials modulo 2**64.
    """
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    salt, first = mixed(np.array([seed], dtype=np.uint64))[0], 0
    for at in range(0, len(values), MIXED_BYTES):
        to = min(at + MIXED_BYTES, len(values))
        word = np.zeros(to - at, dtype=np.int64)
        here = begin[np.searchsorted(begin, at) : np.searchsorted(begin, to)]
        word[here - at] = here
        word[0] = max(word[0], first)
        np.maximum.accumulate(word, out=word)
        first = int(word[-1])
        place = (np.arange(at, to) - word).astype(np.uint64)
        np.cumsum(mixed((place << np.uint64(8) | values[at:to]) + salt), out=sums[at + 1 : to + 1])
        sums[at + 1 : to + 1] += sums[at]
    return mixed(sums[end] - sums[begin] + (end - begin).astype(np.uint64))


class RollingHash:
    """Polynomial hashes modulo 2**64 of all spans of a sequence from one running sum, for spans of under 1,024 values: patterns
    of that many can cancel out."""

    def __init__(self, seed: int):
        self.base = (0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFF8 | 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.powers = self.inverses = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, base in (("powers", self.base), ("inverses", self.inverse)):
                x = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Running sum of values weighted by position, with a zero in front."""
        self._grow(len(values) + 1)
        out = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * self.powers[: len(values)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        self._grow(len(sums))
        return mixed((sums[end] - sums[begin]) * self.inverses[begin])


def words_at(buffer: np.ndarray, ends: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each word in the buffer, and for each text its first word (one more entry than texts).

    in_word: for each byte value, whether words hold it. No word crosses the end of a text.
    """
    w = in_word[buffer]
    first = w.copy()
    first[1:] &= ~w[:-1]
    last = w.copy()
    last[:-1] &= ~w[1:]
    inner = ends[(ends > 0) & (ends < len(buffer))]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begin, end, np.searchsorted(begin, ends, side="left")


#: Bytes that part words, for words [^\x20\x09-\x0D]+.
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[list(BLANKS)] = False


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node that it reaches.

    Each round takes the least root among the neighbours, then the root of that root, so long chains halve;
    rounds end when nothing changes. Only grouped minima and joins, each round written to the shared folder, in
    tasks of about TASK_ROWS edges.
    """
    edges = written(edges.select("a", "b").where("a <> b").distinct())
    tasks = 1 + edges.count() // TASK_ROWS
    both = edges.coalesce(tasks).union(edges.coalesce(tasks).select("b", "a")).toDF("node", "other")
    roots = written(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")).coalesce(tasks))
    while True:
        near = both.join(roots.select(F.col("node").alias("other"), "root"), "other").select("node", "root")
        best = near.union(roots.select("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
        up = roots.select(F.col("node").alias("root"), F.col("root").alias("upper"))
        best = best.join(up, "root", "left").select("node", F.coalesce("upper", "root").alias("root"))
        old = roots.select("node", F.col("root").alias("old"))
        best = written(best.join(old, "node").select("node", "root", (F.col("root") != F.col("old")).alias("moved")).coalesce(tasks))
        roots = best.select("node", "root")
        if not best.where("moved").limit(1).count():
            return roots
