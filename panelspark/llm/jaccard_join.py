"""N-gram Jaccard join: size-banded tiles, hashed bitmaps that bound overlaps from above, exact intersections.

Sets of about one size form a band. Two sets of a band that reach the similarity differ in at most a known number of
shingles, so if the range of hashes is cut into more classes than that, some class holds the same shingles in both.
A tile is a band, a class and what the class holds; only sets that meet in a tile are compared. A tile's sets are
compared to its most central one; what that leaves apart is compared by bitmaps, block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm import simhash
from panelspark.llm.common import components, lean, mixed, needs, row_key, slices, small, utf8, written

#: Sets of a block of a tile: outsiders, and members that they are compared to.
OUTSIDERS, MEMBERS = 64, 256
#: Bytes of sets that are intersected together.
COMPARED_BYTES = 4 << 20
MARKED = "doc_id {}, _row long, node binary, size int, bitmap binary, tiles array<long>"


@cache
def bands() -> np.ndarray:
    """The least size of each band; the next band begins a third higher."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(low[-1] * 4 // 3 + 1)
    return np.array(low)


def classes(band: int, percent: int) -> tuple[int, int]:
    """(classes, spare) of a band. Sets of up to `high` shingles that reach the similarity differ in at most
    `most`; of most + 1 + spare classes, spare + 1 are then equal. No classes where only equal sets reach it."""
    high = int(bands()[band + 1]) - 1
    most = 2 * high * (100 - percent) // (100 + percent)
    spare = 0 if most < 8 else 1 + most // 100
    return (most + 1 + spare if most else 0), spare


def tiles(hashes: np.ndarray, percent: int) -> np.ndarray:
    """The tiles of a sorted set of hashes: those of its band, and of the next one if a set there can be near it.

    An empty class is a tile only of sets that have more empty classes than their band has spare ones: any other
    shares a class that is not empty with all that are near.
    """
    band = int(np.searchsorted(bands(), len(hashes), side="right")) - 1
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(mixed(hashes), out=sums[1:])
    found = []
    for b in (band, band + 1):
        many, spare = classes(b, percent)
        if not many or b > band and 100 * len(hashes) < percent * int(bands()[b]):
            continue
        place = (hashes >> np.uint64(32)) * np.uint64(many) >> np.uint64(32)
        at = np.searchsorted(place, np.arange(many + 1, dtype=np.uint64))
        key = mixed((sums[at[1:]] - sums[at[:-1]]) ^ mixed(np.arange(many, dtype=np.uint64) + np.uint64(b << 40)))
        full = at[1:] > at[:-1]
        found.append(key[full] if many - full.sum() <= spare else key)
    return np.concatenate(found).view(np.int64) if found else np.zeros(0, dtype=np.int64)


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by their low bits; twice to four times as many bits as shingles, 64 at least."""
    bits = max(64, 1 << (2 * len(hashes) - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(one: np.ndarray, words: int) -> np.ndarray:
    """A bitmap in fewer 64-bit words: parities by fewer low bits are parities of parities."""
    while len(one) > words:
        one = one[: len(one) // 2] ^ one[len(one) // 2 :]
    return one


def overlaps_at_most(x: np.ndarray, y: np.ndarray, x_size: int, y_size: int) -> int:
    """A bound from above on the common members: each bit that differs stands for a member that one of the sets lacks."""
    words = min(len(x), len(y))
    return (x_size + y_size - int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())) // 2


def reaches(common, x_size, y_size, percent: int):
    """Whether the similarity is reached with so many common members."""
    return common * (100 + percent) >= percent * (x_size + y_size)


def node(hashes: np.ndarray) -> bytes:
    """128 bits of a set: two sums of its mixed members."""
    with np.errstate(over="ignore"):
        return mixed(hashes).sum(dtype=np.uint64).tobytes() + mixed(hashes ^ np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64).tobytes()


def marks(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, _row, node, size, bitmap, tiles) for each row of docs (doc_id, _row, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(simhash.shingle_hashes(x, width)) for x in utf8(batch.column("text"))]
            columns = [
                pa.array(map(node, sets), pa.binary()), pa.array(map(len, sets), pa.int32()),
                pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()), pa.array([tiles(s, percent) if len(s) else [] for s in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_row"), *columns], names=["doc_id", "_row", "node", "size", "bitmap", "tiles"])

    return docs.mapInArrow(lean(run), MARKED.format(kind))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, size, bitmap, hashes) of texts (text): hashes are the sorted members as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(simhash.shingle_hashes(x, width)) for x in utf8(batch.column("text"))]
            columns = [pa.array(map(node, sets), pa.binary()), pa.array(map(len, sets), pa.int32()), pa.array(map(bitmap, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", "bitmap", "hashes"])

    each = texts.mapInArrow(lean(run), "node binary, size int, bitmap binary, hashes binary")
    return each.groupBy("node").agg(F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("hashes").alias("hashes"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity: by bitmaps those that cannot are left out, the others' sets are intersected."""
    side = lambda t: sets.select(*[F.col(c).alias(f"{t}_{c}") for c in sets.columns]).withColumnRenamed(f"{t}_node", t)
    both = pairs.join(side("b"), "b").join(side("a"), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], "b_hashes", COMPARED_BYTES):
                near = []
                columns = [batch.column(f"{t}_{c}").to_pylist() for t in "ab" for c in ("size", "bitmap", "hashes")]
                for m, x, p, n, y, q in zip(*columns, strict=True):
                    can = reaches(overlaps_at_most(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), m, n), m, n, percent)
                    near.append(can and reaches(len(np.intersect1d(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), assume_unique=True)), m, n, percent))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(lean(run), "a binary, b binary")


def stars(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of each tile's most central set, which has the most company over all of its own tiles, and the others."""
    degree = met.groupBy("node").agg(F.sum("n").alias("degree"))
    central = met.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("c"))
    return met.join(central, "key").where("node <> c.node").selectExpr("c.node a", "node b").distinct()


def apart(met: DataFrame, roots: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets that share a tile but no root, and whose bitmaps allow the similarity. met: (key, node, n), nodes as binary or
    long; roots: (node, root), a node without one is its own; bitmaps: (node, size, bitmap).

    In each tile all that have not the commonest root are outsiders; they alone are compared to the members, a block
    of outsiders to a cell of members at a time, so no task holds a whole tile. A tile of two has been compared.
    """
    rooted = met.join(roots, "node", "left").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    each = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = each.groupBy("key").agg(F.max(F.struct("n", "root")).alias("main"), F.sum("n").alias("total"))
    split = split.where("total > 2 and total > main.n").selectExpr("key", "main.root main", f"cast(ceil((total - main.n) / {OUTSIDERS}) as int) blocks", f"cast(ceil(total / {MEMBERS}) as int) cells")
    rooted = written(rooted.join(split, "key").join(bitmaps, "node").select("key", "node", "root", "main", "blocks", "cells", "size", "bitmap"))
    kept = ["key", "block", "cell", "node", "root", "size", "bitmap"]
    outside = rooted.where("root <> main").withColumn("block", F.expr("cast(pmod(xxhash64(node), blocks) as int)")).withColumn("cell", F.explode(F.expr("sequence(0, cells - 1)")))
    inside = rooted.withColumn("cell", F.expr("cast(pmod(xxhash64(node, 1), cells) as int)")).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))

    def compared(out: pa.Table, members: pa.Table) -> pa.Table:
        a, b = [], []
        names, roots_, sizes = (members.column(c).to_numpy(zero_copy_only=False) for c in ("node", "root", "size"))
        maps = members.column("bitmap").to_pylist()
        #: Members of one length of bitmap, their maps in rows.
        alike: dict[int, list[int]] = {}
        for i, m in enumerate(maps):
            alike.setdefault(len(m) // 8, []).append(i)
        stacked = {words: (np.array(at), np.frombuffer(b"".join(maps[i] for i in at), np.uint64).reshape(-1, words)) for words, at in alike.items()}
        for name, root, size, x in zip(*[out.column(c).to_pylist() for c in ("node", "root", "size", "bitmap")], strict=True):
            x = np.frombuffer(x, np.uint64)
            for words, (at, rows) in stacked.items():
                least = min(words, len(x))
                if words > least:
                    rows = np.bitwise_xor.reduce(rows.reshape(len(rows), -1, least), axis=1)
                differ = np.bitwise_count(rows ^ folded(x, least)).sum(axis=1, dtype=np.int64)
                common = np.minimum((sizes[at] + size - differ) // 2, np.minimum(sizes[at], size))
                for i in at[reaches(common, sizes[at], size, percent)].tolist():
                    if roots_[i] != root:
                        a.append(min(name, names[i]))
                        b.append(max(name, names[i]))
        return pa.table([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])

    kind = pa.binary() if met.schema["node"].dataType.simpleString() == "binary" else pa.int64()
    block = ["key", "block", "cell"]
    return outside.select(kept).groupBy(block).cogroup(inside.select(kept).groupBy(block)).applyInArrow(compared, f"a {met.schema['node'].dataType.simpleString()}, b {met.schema['node'].dataType.simpleString()}").distinct()


def classes_of_near_sets(docs: DataFrame, percent: int = 80, width: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the size of the text's set of `width`-word shingles, and
    the smallest doc_id that links reach from it, itself included. Two texts link when their sets' intersection is at
    least `percent` hundredths (75 to 100) of their union.

    A-Z is lowered, words are parted by ASCII blanks; a text of fewer words than `width` is one shingle, whole. A null,
    empty or blank text has no set and links with nothing: its component is itself. Texts of equal sets are one node, so
    copies cost a row each and no pairs. Rows with null doc_id get their component's smallest id, null if it has none.
    Repeated rows stay, other columns are not used, an empty table stays empty, texts of any length are taken whole.
    """
    needs(docs, text, doc_id)
    if not 75 <= percent <= 100:
        raise ValueError(f"percent {percent}: 75 to 100, so that near sets lie in one band or the next")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = written(marks(docs.select(*row_key(), "text"), width, percent))
    sets = rows.where("size > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_row")).alias("one"), F.first("size").alias("size"), F.first("bitmap").alias("bitmap"), F.first("tiles").alias("tiles"))
    nodes = written(sets)
    dealt = nodes.select(F.explode("tiles").alias("key"), "node")
    met = written(dealt.join(dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "key"))

    wanted = nodes.join(met.select("node").distinct(), "node").select(F.col("one.doc_id").alias("_id"), F.col("one._row").alias("_hash")).hint("shuffle_hash")
    texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (row_key()[1] == F.col("_hash")), "left_semi").select("text")
    contents = written(shingle_sets(texts, width))
    edges = small(written(verified(stars(met), contents, percent)))
    roots = components(edges).toDF("node", "root")
    more = small(written(verified(apart(met, roots, nodes.select("node", "size", "bitmap"), percent), contents, percent)))
    if more.limit(1).count():
        roots = components(edges.union(more)).toDF("node", "root")

    grouped = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.join(smallest, "root").select("node", "component_id")
    found = rows.select("doc_id", "size", F.when(F.col("size") > 0, F.col("node")).alias("node")).join(labels, "node", "left")
    return found.select("doc_id", F.col("size").cast("long").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
