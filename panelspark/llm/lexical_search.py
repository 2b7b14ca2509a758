"""Ranked lexical search: documents are grouped by the mask of an item's terms that they hold, best masks first.

Each task holds a slice of documents as bitmaps, one a term. An item's bitmaps, laid across, give every document's mask;
a mask's score is at most what its terms could give to any document of the slice. Masks are evaluated by descending
bound until the tenth best score, of this slice and those before it, is out of reach. Tasks pass on their best
documents of each item; the best of those are ranked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import lean, needs, slices, utf8

#: Items that are searched together take at most so many bytes of text, or are one item.
BLOCK_BYTES = 4 << 20
#: What an item counts besides its text, so that a block holds a bounded number.
ITEM_BYTES = 64
#: Bytes of a text whose terms are told apart together.
PIECE_BYTES = 4 << 20
#: Parts in which an item's best documents are ranked before they meet.
PARTS = 64
#: A byte for each byte: lower-cased if terms [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+ hold it, else a blank.
LOWERED = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Fixed values of the score: saturation and share of length, in hundredths and eighths.
SCALE, BY_TF, BY_LENGTH, SHARE = 1_000_000_000, 1000, 8, 75


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, a list for each piece of about PIECE_BYTES."""
    text, at = text.translate(LOWERED), 0
    while at < len(text):
        to = text.find(b" ", at + PIECE_BYTES) if at + PIECE_BYTES < len(text) else -1
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


class Queries:
    """A block of items: for each its terms as numbers, ascending, and how often it holds them."""

    def __init__(self, rows: list):
        self.numbers: dict[bytes, int] = {}
        self.parts = []
        for _, text in rows:
            held: dict[int, int] = {}
            for words in pieces((text or "").encode()):
                for w in words:
                    k = self.numbers.setdefault(w, len(self.numbers))
                    held[k] = held.get(k, 0) + 1
            self.parts.append((np.array(sorted(held), dtype=np.int64), np.array([held[k] for k in sorted(held)], dtype=np.int64)))


class Postings:
    """Terms of the items in a slice of documents: entries (document, term, occurrences), by document and term."""

    def __init__(self, texts: list[bytes], numbers: dict[bytes, int]):
        other = self.base = len(numbers)
        size, keys = np.zeros(len(texts), dtype=np.int64), []
        for d, text in enumerate(texts):
            for words in pieces(text):
                size[d] += len(words)
                found = np.fromiter(map(numbers.get, words, repeat(other)), dtype=np.int64, count=len(words))
                keys.append(found[found < other] + d * other)
        self.size = size
        self.key, self.tf = np.unique(np.concatenate(keys) if keys else np.zeros(0, dtype=np.int64), return_counts=True)
        self.doc, self.term = np.divmod(self.key, max(1, other))

    def weighted(self, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        """`value` of each entry, and for each term its greatest value and the bitmap of the documents that hold it."""
        m = np.array([100 - SHARE + SHARE * n * n_docs // n_terms for n in self.size.tolist()], dtype=np.int64)
        self.value = weights[self.term] * (SCALE * self.tf // (BY_TF * self.tf + BY_LENGTH * m[self.doc]))
        self.terms, place = np.unique(self.term, return_inverse=True)
        self.most = np.zeros(len(self.terms), dtype=np.int64)
        np.maximum.at(self.most, place, self.value)
        self.maps = np.zeros((len(self.terms), -(-len(self.size) // 8)), dtype=np.uint8)
        np.bitwise_or.at(self.maps, (place, self.doc >> 3), np.left_shift(1, self.doc & 7).astype(np.uint8))

    def masks(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct masks over the terms at `rows` (a row of 0 and 1 each), the documents by mask, and where each mask's begin."""
        bits = np.unpackbits(self.maps[rows], axis=1, bitorder="little", count=len(self.size))
        packed = np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T)
        wide = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
        wide[:, : packed.shape[1]] = packed
        words = wide.view(np.uint64)
        docs = np.flatnonzero(words.any(axis=1))
        one = words[docs, 0] if words.shape[1] == 1 else np.ascontiguousarray(words[docs]).view(np.dtype((np.void, words.shape[1] * 8)))[:, 0]
        _, first, group = np.unique(one, return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")
        return bits[:, docs[first]].T, docs[by], np.searchsorted(group[by], np.arange(len(first) + 1))

    def scores(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        want = docs[:, None] * self.base + terms[None, :]
        at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return (np.where(self.key[at] == want, self.value[at], 0) * times).sum(axis=1)

    def search(self, terms: np.ndarray, times: np.ndarray, ids: list, best: list, top: int) -> list:
        """The best (-score, no id, id) of `best` and of this slice's documents, at most `top`."""
        rows = np.searchsorted(self.terms, terms)
        here = (rows < len(self.terms)) & (self.terms[np.minimum(rows, len(self.terms) - 1)] == terms) if len(self.terms) else np.zeros(len(terms), dtype=bool)
        if not here.any():
            return best
        rows, terms, times = rows[here], terms[here], times[here]
        masks, docs, begin = self.masks(rows)
        bounds = masks.astype(np.int64) @ (self.most[rows] * times)
        order = np.argsort(-bounds, kind="stable")
        at, batch = 0, 1
        while at < len(order):
            least = max(1, -best[-1][0] if len(best) == top else 1)
            if bounds[order[at]] < least:
                break
            took = [k for k in order[at : at + batch] if bounds[k] >= least]
            chosen = np.concatenate([docs[begin[k] : begin[k + 1]] for k in took])
            score = self.scores(chosen, terms, times)
            near = np.flatnonzero(score >= least)
            if len(near) > top:
                near = near[score[near] >= np.partition(score[near], -top)[-top]]
            best = sorted([*best, *((-int(score[i]), ids[d] is None, ids[d] if ids[d] is not None else 0) for i, d in zip(near, chosen[near].tolist(), strict=True))], key=lambda x: (x[0], x[1], x[2]))[:top]
            at += batch
            batch *= 2
        return best


def statistics(docs: DataFrame, queries) -> tuple[int, int, np.ndarray]:
    """Documents that hold a term, their terms, and for each term of the items the documents that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = queries.value.numbers
        holders, n_docs, n_terms = np.zeros(len(numbers), dtype=np.int64), 0, 0
        for batch in slices(batches, "text"):
            found = Postings(utf8(batch.column("text")), numbers)
            n_docs += int((found.size > 0).sum())
            n_terms += int(found.size.sum())
            holders += np.bincount(found.term, minlength=len(numbers))
        held = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *held.tolist()], pa.int64()), pa.array([n_docs, n_terms, *holders[held].tolist()], pa.int64())], names=["term", "n"])

    counts = docs.select("text").mapInArrow(lean(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    by_term = {r.term: r.n for r in counts.collect()}
    return by_term.get(-1, 0), by_term.get(-2, 0), np.array([by_term.get(k, 0) for k in range(len(queries.value.numbers))], dtype=np.int64)


def blocks(items: DataFrame) -> Iterator[list]:
    """The items, a block of at most BLOCK_BYTES at a time: the driver holds one."""
    block, size = [], 0
    for row in items.toLocalIterator():
        more = len(row[1] or "") + ITEM_BYTES
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += more
    if block:
        yield block


def searched(docs: DataFrame, block: list, item_type: T.DataType, top: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one block of items."""
    session = docs.sparkSession
    queries = session.sparkContext.broadcast(Queries(block))
    n_docs, n_terms, holders = statistics(docs, queries)
    weights = session.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in holders.tolist()], dtype=np.int64))
    schema = T.StructType([T.StructField("q", T.IntegerType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kinds = queries.value, None
        best: list[list] = [[] for _ in asked.parts]
        for batch in slices(batches, "text"):
            kinds = batch.schema.field("doc_id").type
            found = Postings(utf8(batch.column("text")), asked.numbers)
            if len(found.key):
                found.weighted(weights.value, n_docs, n_terms)
                ids = batch.column("doc_id").to_pylist()
                for q, (terms, times) in enumerate(asked.parts):
                    best[q] = found.search(terms, times, ids, best[q], top)
        for q, rows in enumerate(best):
            if rows:
                columns = [pa.array([q] * len(rows), pa.int32()), pa.array([None if none else i for _, none, i in rows], kinds), pa.array([-s for s, _, _ in rows], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["q", "doc_id", "score"])

    rows = docs.mapInArrow(lean(run), schema)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    for by in (["q", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))], ["q"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    named = session.createDataFrame([(q, i) for q, (i, _) in enumerate(block)], T.StructType([schema["q"], T.StructField("item_id", item_type)]))
    return rows.join(F.broadcast(named), "q").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) its `top` documents of highest score above 0.

    Terms are runs of digits, letters and characters beyond ASCII of the whole text, A-Z lowered. Equal scores rank by
    ascending doc_id, rows without doc_id last. Null and empty texts have no terms: such documents are not counted, such
    items find nothing. Each row of items is a query of its own, repeated item_ids too; repeated documents each take a
    rank. Other columns are not used; an empty table on either side gives no rows. Texts of any length are read
    whole, a piece at a time. A block of items costs two passes over the documents.
    """
    needs(docs, "doc_id", "text")
    needs(items, "item_id", "text")
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text")
    out = None
    for block in blocks(items):
        found = searched(docs, block, items.schema["item_id"].dataType, top)
        out = found if out is None else out.union(found)
    return items.crossJoin(docs.select("doc_id")).limit(0).selectExpr("item_id", "1 rank", "doc_id", "0L score") if out is None else out
