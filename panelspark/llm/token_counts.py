"""Token counts of a piece model without ids: pieces once per distinct pre-token, then sums of frequencies."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import needs, slices, written

#: The mark that stands for a space in pieces.
MARK = "▁"
#: A pre-token with at least one in HOT_SHARE of all occurrences is hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1 << 20
#: Distinct pre-tokens that a Python worker counts before it passes on those that occurred LEAST times.
COUNTED, LEAST = 400_000, 6
#: Counts of rare pre-tokens that a Python worker remembers.
REMEMBERED = 500_000


class Pieces:
    """A sentencepiece model with byte fallback, cut where no piece can reach across."""

    held: dict[bytes, Pieces] = {}

    def __init__(self, model: bytes):
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        sp = self.whole
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = [sp.id_to_piece(i) for i in usable]
        if any(MARK in p.lstrip(MARK) for p in pieces) or not any(sp.is_byte(i) for i in range(sp.get_piece_size())):
            raise ValueError("pieces reach across spaces, or unknown characters are no bytes: counts of parts would not add up")
        joining = sorted({c for p in pieces if len(p) > 1 for c in p} - {MARK})
        inner = "".join(map(re.escape, joining))
        #: A pre-token: marks with the run of joining characters behind them, marks, or a run of others.
        pattern = f"{MARK}*[{inner}]+|{MARK}+|[^{inner}{MARK}]+" if joining else f"{MARK}+|[^{MARK}]+"
        self.split = re.compile(pattern).findall
        #: A character that stands alone in front of a part, so that no prefix is put to the part itself.
        self.apart = next(c for c in "\n\x01\x02¤" if c not in joining and c in sp.normalize(f"a{c}b"))
        self.before = len(sp.encode(self.apart))

    @classmethod
    def of(cls, model: bytes) -> Pieces:
        if model not in cls.held:
            cls.held = {model: cls(model)}
        return cls.held[model]

    def frequencies(self, text: str | None) -> Counter:
        return Counter(self.split(self.whole.normalize(text))) if text else Counter()

    def counts(self, parts: list[str]) -> list[int]:
        return [len(x) - self.before for x in self.whole.encode([self.apart + p for p in parts], num_threads=1)] if parts else []


def frequent(docs: DataFrame, model) -> DataFrame:
    """(part, n): occurrences of pre-tokens that are frequent somewhere; a hint for the choice of hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, seen, total = Pieces.of(model.value), Counter(), 0

        def passed_on() -> pa.RecordBatch:
            many = [(p, n) for p, n in seen.items() if n >= LEAST]
            return pa.RecordBatch.from_arrays([pa.array([None, *[p for p, _ in many]], pa.string()), pa.array([total, *[n for _, n in many]], pa.int64())], names=["part", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column("text").to_pylist():
                if text:
                    parts = pieces.split(pieces.whole.normalize(text))
                    seen.update(parts)
                    total += len(parts)
            if len(seen) > COUNTED:
                yield passed_on()
                seen, total = Counter(), 0
        yield passed_on()

    return docs.select("text").mapInArrow(run, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))


def hot_counts(docs: DataFrame, model) -> dict[str, int]:
    """Pieces of each hot pre-token; at most HOT_SHARE entries, since each has that share of all occurrences."""
    found = written(frequent(docs, model))
    total = found.where("part is null").agg(F.sum("n")).first()[0] or 0
    hot = found.where(F.col("part").isNotNull() & (F.col("n") * HOT_SHARE >= total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("part").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("part"), pa.array(Pieces.of(model.value).counts(parts), pa.int32())], names=["part", "pieces"])

    return {r.part: r.pieces for r in hot.select("part").mapInArrow(run, "part string, pieces int").collect()}


ROWS = "rid long, part string, freq int, doc_id long, n_bytes long, tokens long"


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs.

    Tokens are counted as the sentencepiece model gives them for the whole text, without begin or end marks;
    a null text is as empty: 0. over_limit is whether there are more than `limit`. Rows are told apart by
    place, so repeated rows, and rows with one or no doc_id, each have their own count. An empty table stays empty; other
    columns, whatever their names, are dropped.

    No piece reaches across the places where `Pieces` cuts, so a text's count is the sum over its distinct
    pre-tokens of frequency times pieces. Hot pre-tokens, of which there is a bounded number, are counted
    once and broadcast; every other meets its frequencies of all documents in one task, dealt by pre-token,
    is counted there once, and adds to each document. All texts are counted whole and no ids are made.
    """
    needs(docs, "doc_id", "text")
    context = docs.sparkSession.sparkContext
    with open(model_path, "rb") as f:
        model = context.broadcast(f.read())
    hot = context.broadcast(hot_counts(docs, model))
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid"))
    schema = ROWS.replace("doc_id long", f"doc_id {docs.schema['doc_id'].dataType.simpleString()}")
    names = [x.split()[0] for x in ROWS.split(", ")]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Pieces.of(model.value), hot.value
        for batch in slices(batches, "text"):
            rids, parts, freqs, sizes, sums = [], [], [], [], []
            texts = batch.column("text").to_pylist()
            for rid, text in zip(batch.column("rid").to_pylist(), texts, strict=True):
                tokens = 0
                for part, n in pieces.frequencies(text).items():
                    if part in known:
                        tokens += n * known[part]
                    else:
                        rids.append(rid)
                        parts.append(part)
                        freqs.append(n)
                sizes.append(len((text or "").encode()))
                sums.append(tokens)
            kind = batch.schema.field("doc_id").type
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.nulls(len(texts), pa.string()), pa.nulls(len(texts), pa.int32()), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())], names=names)
            if rids:
                n = len(rids)
                yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(parts, pa.string()), pa.array(freqs, pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known = Pieces.of(model.value), {}
        for batch in slices(batches, "part"):
            own = batch.filter(batch.column("part").is_null())
            if own.num_rows:
                yield own.select(["rid", "doc_id", "n_bytes", "tokens"])
            rest = batch.filter(batch.column("part").is_valid())
            if not rest.num_rows:
                continue
            parts = rest.column("part").to_pylist()
            if len(known) > REMEMBERED:
                known.clear()
            new = [*set(parts).difference(known)]
            known.update(zip(new, pieces.counts(new), strict=True))
            tokens = np.fromiter(map(known.__getitem__, parts), dtype=np.int64, count=len(parts)) * rest.column("freq").to_numpy()
            n = len(parts)
            yield pa.RecordBatch.from_arrays([rest.column("rid"), pa.nulls(n, batch.schema.field("doc_id").type), pa.nulls(n, pa.int64()), pa.array(tokens)], names=["rid", "doc_id", "n_bytes", "tokens"])

    rows = numbered.mapInArrow(spread, schema)
    dealt = rows.repartition(F.col("part"), F.when(F.col("part").isNull(), F.col("rid")))
    schema = ", ".join(x for x in schema.split(", ") if x.split()[0] in ("rid", "doc_id", "n_bytes", "tokens"))
    each = dealt.mapInArrow(counted, schema).groupBy("rid").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("tokens").alias("n_tokens"))
    return each.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
