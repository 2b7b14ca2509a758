"""Language identification: each text as a mixture of languages, found by expectation-maximisation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import SLICE_BYTES, fields, joined, needs, slices, without

#: Hashed n-grams: bits of the table, and bytes of an n-gram.
BITS, GRAM = 16, 4
BUCKETS = 1 << BITS
#: More languages than this are refused: the model is one table of BUCKETS x languages, sent to every executor.
MOST_LANGUAGES = 256
#: Rounds of expectation-maximisation, and what a further language must gain: PENALTY * log(n-grams).
ROUNDS, PENALTY = 12, 8.0
SHARE = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())]))
LETTER = regex.compile(r"\p{L}")

#: Bytes as n-grams see them: A-Z lowered, ASCII that is no letter as a blank.
SEEN = np.arange(256, dtype=np.uint64)
SEEN[:0x80] = 0x20
SEEN[0x61:0x7B] = SEEN[0x41:0x5B] = np.arange(0x61, 0x7B)


def held_out() -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of the distinct hashed n-grams of each text, in order of text; blank n-grams left out."""
    buffer, ends = joined(column)
    n = max(0, len(buffer) - GRAM + 1)
    seen = SEEN[buffer]
    code = np.zeros(n, dtype=np.uint64)
    for k in range(GRAM):
        code = code << np.uint64(8) | seen[k : k + n]
    text = np.repeat(np.arange(len(ends) - 1, dtype=np.uint64), np.diff(ends))
    blank = sum(0x20 << 8 * k for k in range(GRAM))
    whole = (text[:n] == text[GRAM - 1 : GRAM - 1 + n]) & (code != blank)
    bucket = (code[whole] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
    key, count = np.unique(text[:n][whole] << np.uint64(BITS) | bucket, return_counts=True)
    return (key >> np.uint64(BITS)).astype(np.int64), (key & np.uint64(BUCKETS - 1)).astype(np.int64), count.astype(np.float64)


def learn(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and, for each bucket and language, the n-gram's probability, from all rows of train (text, lang).

    Rows with null text or lang teach nothing. Counts are summed in tasks, then by (lang, bucket): the table that
    reaches the driver has at most BUCKETS rows for each of at most MOST_LANGUAGES languages.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, x in sums.items():
                at = np.flatnonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], names=["lang", "bucket", "n"])
            sums.clear()

        for batch in slices(batches, "text"):
            text, bucket, count = grams(batch.column("text"))
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs], dtype=np.int64)[text] if len(text) else text
            for k, lang in enumerate(names):
                mine = number == k
                sums.setdefault(lang, np.zeros(BUCKETS))[:] += np.bincount(bucket[mine], count[mine], BUCKETS)
            if len(sums) > 32:
                yield from passed_on()
        yield from passed_on()

    train = train.where("text is not null and lang is not null").select("text", "lang")
    langs = sorted(r.lang for r in train.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = np.zeros((BUCKETS, len(langs)))
    table = train.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    if table.num_rows:
        at = {x: k for k, x in enumerate(langs)}
        counts[table.column("bucket").to_numpy(), [at[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    smooth = counts + 0.5
    return langs, smooth / smooth.sum(axis=0)


def em(p: np.ndarray, count: np.ndarray, first: np.ndarray, text: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shares of each language in each text, the log-likelihood under them, and what no shares at all can exceed.

    p: a row for each language, with the probability of each text's n-grams; texts begin at `first` and `text`
    numbers them. The log-likelihood is concave in the shares, so its tangent at any shares bounds it everywhere:
    the greatest slope less the mean one, n, is the most that is still to be gained.
    """
    share = np.full((len(p), len(first)), 1 / len(p))

    def mixed() -> np.ndarray:
        out = p[0] * share[0][text]
        for row, part in zip(p[1:], share[1:], strict=True):
            out += row * part[text]
        return out

    for _ in range(ROUNDS):
        weight = count / mixed()
        share = share * np.array([np.add.reduceat(row * weight, first) for row in p]) / n
    mix = mixed()
    slopes = np.array([np.add.reduceat(row * (count / mix), first) for row in p])
    value = np.add.reduceat(np.log(mix) * count, first)
    return share, value, value + np.maximum(slopes.max(axis=0) - n, 0)


def mixture(p: np.ndarray, count: np.ndarray, alone: np.ndarray, bound: float) -> np.ndarray:
    """Shares for one text: languages join one by one, the best first, while each gains more than the penalty; none
    can gain more than what is left to the bound."""
    n = count.sum()
    cost, chosen = PENALTY * math.log(n + 1), [int(alone.argmax())]
    best, shares = alone.max(), np.ones(1)
    start, whole, total = np.zeros(1, dtype=np.int64), np.zeros(len(count), dtype=np.int64), np.array([n])
    while len(chosen) < len(p) and bound - best > cost:
        tried = []
        for lang in range(len(p)):
            if lang not in chosen:
                share, value, _ = em(p[[*chosen, lang]], count, start, whole, total)
                tried.append((value[0], lang, share[:, 0]))
        value, lang, share = max(tried, key=lambda x: x[:2])
        if value - best <= cost:
            break
        best, shares, chosen = value, share, [*chosen, lang]
    out = np.zeros(len(p))
    out[chosen] = shares
    return out


def shares_of(column: pa.Array, model: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text; rows of zeros for texts without n-grams."""
    text, bucket, count = grams(column)
    out = np.zeros((len(column), model.shape[1]))
    if not len(text) or not model.shape[1]:
        return out
    first = np.flatnonzero(np.diff(text, prepend=-1))
    dense = np.cumsum(np.diff(text, prepend=text[0]) > 0)
    p, n = np.ascontiguousarray(model[bucket].T), np.add.reduceat(count, first)
    alone = np.array([np.add.reduceat(np.log(row) * count, first) for row in p]).T
    # No set of languages exceeds the bound over all of them, so most texts need no search for a second one.
    _, _, bound = em(p, count, first, dense, n)
    last = np.append(first[1:], len(text))
    single = bound - alone.max(axis=1) <= PENALTY * np.log(n + 1)
    which = text[first]
    out[which[single], alone.argmax(axis=1)[single]] = 1
    for k in np.flatnonzero(~single).tolist():
        part = slice(first[k], last[k])
        out[which[k]] = mixture(p[:, part], count[part], alone[k], bound[k])
    return out


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """docs with lang_pred, score (its share of the text) and languages (all chosen ones with their shares).

    Only the text is looked at, whole, however long. `und` with score 0 if it is null, has no letter (Unicode category
    L), or no language is known; a text too short for an n-gram gets the first language with an even share. Ties go to
    the language that sorts first. Columns of docs with the names of outputs are replaced; repeated rows stay; an
    empty table stays empty.
    """
    needs(docs, "text")
    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("languages", SHARE)]
    docs = without(docs, [n for n, _ in added])
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = shared.value
        limit = max(1 << 16, SLICE_BYTES // max(1, len(names) // 4))
        for batch in slices(batches, "text", limit):
            shares = shares_of(batch.column("text"), table)
            pred, score, found = [], [], []
            for text, share in zip(batch.column("text").to_pylist(), shares, strict=True):
                if not names or not text or not LETTER.search(text):
                    pred.append("und")
                    score.append(0.0)
                    found.append([])
                    continue
                if not share.any():
                    share = np.full(len(names), 1 / len(names))
                best = int(share.argmax())
                pred.append(names[best])
                score.append(float(min(1.0, share[best])))
                found.append([{"lang": names[k], "share": float(share[k])} for k in np.flatnonzero(share)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(found, kind)], names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(run, fields(docs, *added))
