"""Near copies by similarity of their sets of shingles, for texts whose fingerprints are too far apart for balls.

At a similarity of 0.8 fingerprints differ in ten bits and more, where balls hold millions of variants. Least hashes of
shingles agree with the similarity's probability, so a few bands of them bring near copies together. Each text of a
bucket is compared shingle by shingle to the bucket's most central one; texts of a bucket that this leaves apart are
compared to each other where bitmaps of their shingles allow the similarity at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import jaccard_join, simhash
from panelspark.llm.common import components, fields, lean, mixed, row_key, slices, small, utf8, without, written

#: Bands, and least hashes in each: two texts of similarity 0.8 share no band with probability (1 - 0.8**5)**24 = 7e-5.
BANDS, EACH = 24, 5
#: Shingles whose hashes are taken together.
BLOCK = 1 << 12
#: Fixed odd factors and offsets of the hash functions.
FACTORS = (mixed(np.arange(1, BANDS * EACH + 1, dtype=np.uint64)) | np.uint64(1))[:, None]
OFFSETS = mixed(np.arange(1001, 1001 + BANDS * EACH, dtype=np.uint64))[:, None]
#: Bytes of sets of shingles that are compared together.
COMPARED_BYTES = 4 << 20


def bands(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of least hashes; none without shingles."""
    if not len(hashes):
        return np.zeros(0, dtype=np.int64)
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), BLOCK):
        np.minimum(least, (hashes[None, i : i + BLOCK] * FACTORS + OFFSETS).min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, EACH).T:
        key = mixed(key ^ column)
    return key.view(np.int64)


def marks(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """docs with `fp`, the fingerprint, `bands`, the keys of the text's bands, and `size`, its number of distinct shingles."""
    added = [("fp", T.LongType()), ("bands", T.ArrayType(T.LongType())), ("size", T.IntegerType())]
    docs = without(docs, [n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            prints, keys, sizes = [], [], []
            for x in utf8(batch.column(text)):
                hashes = simhash.shingle_hashes(x, width)
                distinct = np.unique(hashes)
                prints.append(simhash.majority(hashes))
                keys.append(bands(distinct))
                sizes.append(len(distinct))
            got = [pa.array(np.array(prints, dtype=np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *got], names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(lean(run), fields(docs, *added))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(_row, hashes) of texts (_row, text): the sorted distinct 64-bit hashes of each text's shingles, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(simhash.shingle_hashes(x, width)).tobytes() for x in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(sets, pa.binary())], names=["_row", "hashes"])

    return texts.mapInArrow(lean(run), "_row long, hashes binary")


def common_shingles(jaccard: float, x: str, y: str) -> str:
    """SQL: the least number of common shingles with which sets of x and y shingles reach the similarity."""
    return f"cast(ceil({jaccard!r}D / (1 + {jaccard!r}D) * ({x} + {y}) - 1e-9D) as int)"


def verified(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """Edges (a, b) of the pairs (a, a_row, b, b_row) whose sets of shingles have the similarity."""
    both = pairs.join(sets.toDF("b_row", "b_set"), "b_row").join(sets.toDF("a_row", "a_set"), "a_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "b_set", COMPARED_BYTES):
                near = []
                for x, y in zip(utf8(batch.column("a_set")), utf8(batch.column("b_set")), strict=True):
                    p, q = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    near.append(shared > 0 and shared >= jaccard * (len(p) + len(q) - shared) - 1e-9)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.select("a", "b", "a_set", "b_set").mapInArrow(lean(run), "a long, b long").distinct()


def bitmaps(sets: DataFrame) -> DataFrame:
    """(node, size, bitmap) of sets (_row, hashes): parities of the shingles' hashes, which bound the overlap of two sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "hashes"):
            x = [np.frombuffer(b, dtype=np.uint64) for b in utf8(batch.column("hashes"))]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(map(len, x), pa.int32()), pa.array(map(jaccard_join.bitmap, x), pa.binary())], names=["node", "size", "bitmap"])

    return sets.mapInArrow(lean(run), "node long, size int, bitmap binary")


def roots(docs: DataFrame, rows: DataFrame, edges: DataFrame, width: int, jaccard: float) -> DataFrame:
    """(fp, root) of the fingerprints that any link connects: `edges`, and texts of that similarity that share a band.

    A bucket's members are compared to its most central one, which has the most company over all of its own
    buckets: one row each. Where that leaves a bucket unconnected, its members outside its commonest component are compared to
    the others by bitmaps, block by block, and the sets of those that can reach the similarity are intersected.
    """
    members = written(rows.groupBy("_row").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.min("doc_id").alias("one")))
    dealt = members.select(F.explode("bands").alias("key"), "fp", "_row", "size")
    keys = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("company"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("low < high")
    met = written(dealt.join(keys.select("key", "company"), "key"))
    degree = met.groupBy("_row").agg(F.sum("company").alias("degree"))
    central = met.join(degree, "_row").groupBy("key").agg(F.max(F.struct("degree", "fp", "_row", "size")).alias("c"))
    stars = met.join(central, "key").where(f"fp <> c.fp and least(size, c.size) >= {common_shingles(jaccard, 'size', 'c.size')}")
    stars = stars.selectExpr("c.fp a", "c._row a_row", "fp b", "_row b_row").distinct()
    # One document stands for all copies of its text, so that they do not meet in one task.
    wanted = members.join(met.select("_row").distinct(), "_row").select(F.col("one").alias("_id"), F.col("_row").alias("_hash")).hint("shuffle_hash")
    texts = docs.select(*row_key(), "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_hash")), "left_semi")
    sets = written(shingle_sets(texts.groupBy("_row").agg(F.first("text").alias("text")), width))
    edges = small(written(edges.select("a", "b").union(verified(stars, sets, jaccard))))
    found = components(edges).toDF("fp", "root")

    rows = members.select("_row", "fp").join(found, "fp", "left").select(F.col("_row").alias("node"), F.coalesce("root", "fp").alias("root"))
    near = jaccard_join.apart(met.select("key", F.col("_row").alias("node"), F.col("company").alias("n")), written(rows), bitmaps(sets), round(100 * jaccard))
    of = lambda x: members.select(F.col("_row").alias(f"{x}_row"), F.col("fp").alias(x))
    pairs = written(near.toDF("a_row", "b_row").join(of("a"), "a_row").join(of("b"), "b_row").select("a", "a_row", "b", "b_row"))
    more = small(written(verified(pairs, sets, jaccard)))
    if not more.limit(1).count():
        return found
    return components(edges.union(more)).toDF("fp", "root")
