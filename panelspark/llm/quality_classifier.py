"""Quality classifier: ordinal cumulative-link regression on hashed words, one weight vector, ordered thresholds."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import fields, needs, slices, utf8, without

#: Hashed words, and the greatest number of rated documents that the regression is fitted on.
BUCKETS, MOST_ROWS = 1 << 18, 20_000
#: Full gradient steps, their size, and the weight of the squared weights.
STEPS, RATE, RIDGE = 250, 0.05, 3e-4
#: Letters and digits, or signs: each is a word.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[!-/:-@\[-`{-~]+").findall


SIGN = re.compile(rb"[#*$%&|<>]").findall


def style(text: bytes) -> list[int]:
    """Buckets for tenths of: words in capitals, words equal to the one before, signs a word, distinct words."""
    words = text.split()
    n = max(1, len(words))
    shares = {
        b"capitals": sum(map(bytes.isupper, words)) / n,
        b"again": sum(map(bytes.__eq__, words, words[1:])) / n,
        b"signs": len(SIGN(text)) / n,
        b"distinct": len(set(words)) / n,
    }
    return [zlib.crc32(b"\x00%s%d" % (k, min(10, int(10 * v + 0.999)))) % BUCKETS for k, v in shares.items()]


def buckets(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """Distinct buckets of the words of a text, A-Z lowered, and of its style."""
    words = set(WORD(text.lower()))
    for w in words.difference(known):
        known[w] = zlib.crc32(w) % BUCKETS
    return np.unique(np.array([*map(known.__getitem__, words), *style(text)], dtype=np.int32))


def hashed(batch: pa.RecordBatch, known: dict[bytes, int]) -> list[np.ndarray]:
    if len(known) > 500_000:
        known.clear()
    return [buckets(x, known) for x in utf8(batch.column("text"))]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds t of P(grade <= k) = sigmoid(t[k] - f), f the sum of the buckets' weights, by Adam
    on the whole likelihood with a ridge, which also keeps the weights of rare buckets small. A text's length does
    not dilute a word's weight."""
    size = np.array([len(x) for x in rows])
    index, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), size)
    # Parameters: weights, the first threshold, and logarithms of the steps to the others.
    share = np.cumsum(np.bincount(grade, minlength=grades) + 1)[:-1] / (len(grade) + grades)
    start = np.log(share / (1 - share))
    x = np.concatenate([np.zeros(BUCKETS), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, STEPS + 1):
        cuts = np.concatenate([[-np.inf], thresholds(x), [np.inf]])
        f = np.bincount(row, x[index], len(rows))
        low, high = sigmoid(cuts[grade] - f), sigmoid(cuts[grade + 1] - f)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_f = (d_high - d_low) / len(rows)
        g_cut = (np.bincount(grade, -d_high, grades)[:-1] + np.bincount(grade, d_low, grades)[1:]) / len(rows)
        behind = np.cumsum(g_cut[::-1])[::-1]
        g = np.concatenate([np.bincount(index, g_f[row], BUCKETS) + RIDGE * x[:BUCKETS], behind[:1], behind[1:] * np.exp(x[BUCKETS + 1 :])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return x[:BUCKETS].astype(np.float32), thresholds(x)


def thresholds(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate([x[BUCKETS : BUCKETS + 1], np.exp(x[BUCKETS + 1 :])]))


def sample(docs: DataFrame, ratings: DataFrame, most: int) -> DataFrame:
    """(doc_id, text, grade) of rated documents, of at most `most` ids, those that hash least. Null ids, texts and grades have no part."""
    rated = ratings.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # At most `most` rows, so they may be broadcast.
    return docs.where("text is not null").select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")


def learn(docs: DataFrame, ratings: DataFrame, grades: int, most: int = MOST_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds from ratings (doc_id, grade in 0..grades-1); of several grades of one id the least holds.

    Words are hashed where the texts are; only lists of distinct buckets, `most` of them at most whatever ids repeat,
    meet in the one task that fits: rows with the least hashes of their id, then of their buckets. Texts are taken whole;
    an empty text has the buckets of its style. Without rated texts all weights are 0 and all grades equally likely.
    Rows with an id of a rated text each count.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(hashed(batch, known), pa.list_(pa.int32())), batch.column("grade").cast(pa.int32())], names=["doc_id", "buckets", "grade"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, grade = [], []
        for batch in batches:
            flat, size = batch.column("buckets").flatten().to_numpy(), batch.column("buckets").value_lengths().to_numpy()
            rows += np.split(flat, np.cumsum(size)[:-1])
            grade += batch.column("grade").to_pylist()
        order = sorted(range(len(rows)), key=lambda i: (grade[i], rows[i].tobytes()))  # the same sums however rows arrive
        if rows:
            weights, cuts = fit([rows[i] for i in order], np.array([grade[i] for i in order]), grades)
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()]), pa.array([cuts.tobytes()])], names=["weights", "cuts"])

    rated = sample(docs, ratings.where(f"grade >= 0 and grade < {grades}"), most)
    table = rated.mapInArrow(features, T.StructType([rated.schema["doc_id"], T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("grade", T.IntegerType())]))
    table = table.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("buckets"), "grade").limit(most).select("buckets", "grade")
    got = table.repartition(1).mapInArrow(fitted, "weights binary, cuts binary").collect()
    if not got:
        share = np.arange(1, grades) / grades
        return np.zeros(BUCKETS, dtype=np.float32), np.log(share / (1 - share))
    return np.frombuffer(got[0].weights, dtype=np.float32), np.frombuffer(got[0].cuts, dtype=np.float64)


def grade(docs: DataFrame, weights: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """docs with expected_grade and tails, the array of P(grade >= 1), P(grade >= 2), ...

    A null text is graded as an empty one, a text of any length whole. Rows with equal texts have equal grades;
    repeated rows stay; an empty table stays empty; columns of docs with these names are replaced.
    """
    needs(docs, "text")
    added = [("expected_grade", T.DoubleType()), ("tails", T.ArrayType(T.DoubleType()))]
    docs = without(docs, [n for n, _ in added])
    shared = docs.sparkSession.sparkContext.broadcast((weights, cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = shared.value
        known: dict[bytes, int] = {}
        for batch in slices(batches, "text"):
            f = np.array([w[x].sum(dtype=np.float64) for x in hashed(batch, known)])
            tails = 1 - sigmoid(t[None, :] - f[:, None])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tails.sum(axis=1)), pa.array(list(tails), pa.list_(pa.float64()))], names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(run, fields(docs, *added))
