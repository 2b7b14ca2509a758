"""SimHash near-dedup by balls: every fingerprint emits its variants within half the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm import similar
from panelspark.llm.common import components, fields, lean, needs, row_key, slices, utf8, without, written

#: Shingles whose bits are counted together.
BLOCK = 1 << 16
SEED = 42


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """A hash for each shingle of the text, repeats included; none for a text without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    text = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(text, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    begin = np.cumsum(size + 1) - size - 1
    end = (begin + size)[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin.tolist(), end, strict=False)), dtype=np.uint64, count=len(end))


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is set if it is set in over half the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = hashes[i : i + BLOCK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, width: int) -> int:
    """64 bits: bit i is set if it is set in over half the hashes of the text's shingles, repeats included."""
    return majority(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, width: int = 5, text: str = "text") -> DataFrame:
    """docs with `fp`, the fingerprint as a signed 64-bit integer.

    Words are parted by ASCII blanks and A-Z is lowered; fewer words than `width` are one shingle; a null,
    empty or blank text has fingerprint zero. Any length of text is taken whole.
    """
    needs(docs, text)
    docs = without(docs, ["fp"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            got = np.array([fingerprint(x, width) for x in utf8(batch.column(text))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got)], names=[*batch.schema.names, "fp"])

    return docs.mapInArrow(lean(run), fields(docs, ("fp", T.LongType())))


def variants(fp: str, radius: int) -> F.Column:
    """Array of all values within `radius` differing bits (0 or 1, or 2) of the fingerprint."""
    one = f"transform(sequence(0, 63), i -> {fp} ^ shiftleft(1L, i))"
    two = f"flatten(transform(sequence(0, 62), i -> transform(sequence(i + 1, 63), j -> {fp} ^ shiftleft(1L, i) ^ shiftleft(1L, j))))"
    return F.expr("concat(" + ", ".join([f"array({fp})", one, two][: radius + 1]) + ")")


def links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (a, b) that connect any two fingerprints of `distinct` (fp) at `distance` or fewer differing bits.

    Two fingerprints that near share a variant within half the distance (rounded up), so all that share a
    variant meet there. Among distinct fingerprints a ball of radius r holds a bounded number (65 for r = 1),
    so each links to the least of its ball: a star, not all pairs. For an even distance all in one ball are
    near each other; otherwise pairs are verified, and then all pairs of the ball, still bounded, are compared.
    Balls of a radius above 2, for distances above 4, are refused: they hold over 40,000 variants each.
    """
    if not 0 <= distance <= 4:
        raise ValueError(f"distance {distance}: 0 to 4 bits can be linked by balls")
    radius = (distance + 1) // 2
    balls = distinct.select("fp", F.explode(variants("fp", radius)).alias("ball"))
    if distance % 2:
        pairs = balls.alias("x").join(balls.alias("y"), F.expr("x.ball = y.ball and x.fp < y.fp")).selectExpr("x.fp a", "y.fp b")
    else:
        least = F.expr("min(fp) over (partition by ball)")
        pairs = balls.select(F.col("fp").alias("b"), least.alias("a")).where("a < b")
    return pairs.where(f"bit_count(a ^ b) <= {distance}").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 5, text: str = "text", doc_id: str = "doc_id", jaccard: float | None = None) -> DataFrame:
    """(doc_id, _row, fp, component_id) for each row of docs: the smallest doc_id reachable over links of
    `distance` or fewer bits, and a hash of the text that tells rows of one id apart. With `jaccard`, texts whose
    sets of shingles have at least that similarity are linked too, however far apart their fingerprints are.

    One row in, one row out. Equal fingerprints are one node, so copies cost a row each and no pairs.
    Null, empty and blank texts share fingerprint zero and link like any others. Rows with null doc_id get
    their component's smallest id, null if it has none. Repeated rows stay; an empty table stays empty.
    """
    needs(docs, text, doc_id)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if jaccard is None:
        rows = written(fingerprints(rows, width).select(*row_key(), "fp"))
        edges = links(rows.select("fp").distinct(), distance)
        roots = components(edges).toDF("fp", "root")
    else:
        texts, rows = rows, written(similar.marks(rows, width).select(*row_key(), "fp", "bands", "size"))
        roots = similar.roots(texts, rows, links(rows.select("fp").distinct(), distance), width, jaccard)
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grouped = nodes.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = grouped.select("fp", "root").join(smallest, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", "_row", "fp", "component_id")


def keep_one(docs: DataFrame, distance: int = 2, width: int = 5, jaccard: float | None = None) -> DataFrame:
    """docs less all rows whose id is not the smallest of their component.

    Rows that have that id stay, repeated ones too. A component without any id keeps its rows. Null, empty and blank texts are
    one component; an empty table stays empty; the columns of docs stay, whatever their names.
    """
    rest = near_duplicates(docs, distance, width, jaccard=jaccard).where("component_id is not null and not (doc_id <=> component_id)")
    rest = rest.select(F.col("doc_id").alias("_ps_id"), F.col("_row").alias("_ps_hash")).distinct().hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_ps_id")) & (row_key()[1] == F.col("_ps_hash"))
    return docs.join(rest, same, "left_anti")
