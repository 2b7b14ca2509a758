"""Byte-level BPE encoding and decoding: the tokenizers library over Arrow batches."""

from __future__ import annotations

import array
import base64
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from panelspark.llm.common import fields, lean, needs, slices, without

#: Pre-tokens that a Python worker remembers; longer ones than WORD_LIMIT are not kept. How many are encoded at
#: once, and bytes of text that are split at once.
WORDS_KEPT, WORD_LIMIT, AT_ONCE, TEXT_AT_ONCE = 100_000, 64, 2048, 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes stand for themselves, others come from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and rank, from lines of base64 and number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def tokenizer_json(ranks: dict[bytes, int]) -> str:
    """A definition for the tokenizers library that merges as the ranks do.

    Any two neighbours whose join has a rank may merge, lowest rank first, so every split of a token into
    two tokens becomes a merge, in the order of the joined token's rank. A pre-token that is a token as it
    stands is taken whole.
    """
    chars = byte_characters()
    text = {token: "".join(map(chars.__getitem__, token)) for token in ranks}
    merges = [
        [text[token[:i]], text[token[i:]]]
        for token, _ in sorted(ranks.items(), key=lambda x: x[1])
        for i in range(1, len(token))
        if token[:i] in ranks and token[i:] in ranks
    ]
    model = {"type": "BPE", "vocab": {text[t]: r for t, r in ranks.items()}, "merges": merges, "ignore_merges": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    return json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": level, "decoder": level, "model": model})


class Coder:
    """The tokenizers library for one vocabulary, with the ids of recent pre-tokens."""

    def __init__(self, definition: str, pattern: str):
        # A task has one core; the library's own threads would each keep memory for themselves.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(definition)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.find(x) for x in texts]
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        new = [*set().union(*split).difference(self.known)]
        for i in range(0, len(new), AT_ONCE):
            part = new[i : i + AT_ONCE]
            got = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            self.known.update((w, array.array("I", e.ids).tobytes()) for w, e in zip(part, got, strict=True))
        out = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > WORD_LIMIT:
                del self.known[w]
        return out


def byte_table(vocabulary: dict[str, int]) -> list[bytes]:
    """The bytes of each token id, by the reversed byte table."""
    byte_of = {c: b for b, c in enumerate(byte_characters())}
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for token, i in vocabulary.items():
        table[i] = bytes(map(byte_of.__getitem__, token))
    return table


def byte_offsets(ids: bytes, length: np.ndarray) -> np.ndarray:
    """Where each token begins, in bytes of the text, and the text's end; length: bytes of each token."""
    out = np.zeros(len(ids) // 4 + 1, dtype=np.int64)
    np.cumsum(length[np.frombuffer(ids, dtype="<u4")], out=out[1:])
    return out


def char_offsets(text: bytes, offsets: np.ndarray) -> np.ndarray:
    """The character that holds each byte offset; a token inside a character has that character's place."""
    lead = (np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80
    before = np.concatenate([[0], np.cumsum(lead)])
    inside = np.concatenate([~lead, [False]])
    return before[offsets] - inside[offsets]


def decoded_bytes(table: list[bytes], ids: list[bytes | None]) -> list[bytes | None]:
    """Bytes that ids stand for. Tokens are joined before any text is made, as a character may lie in several."""
    token = table.__getitem__
    return [None if x is None else b"".join(map(token, np.frombuffer(x, dtype="<u4").tolist())) for x in ids]


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """docs with `ids_le` (ids as little-endian unsigned 32-bit integers), `n_tokens`, and on request the
    arrays `byte_offsets` and `char_offsets` of each token's begin, ended by the text's length, and `decoded`:
    the bytes that the ids stand for, made from the ids alone in the same pass.

    Each match of `pattern` is encoded by itself, special strings are ordinary text, and null is as empty:
    no ids. Any length of text is taken whole; repeated rows stay; an empty table gives an empty table.
    Columns of docs with the names of these outputs are replaced.
    """
    needs(docs, text)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer_json(read_ranks(ranks_path)))
    added = [("ids_le", T.BinaryType()), ("n_tokens", T.LongType())]
    if offsets:
        added += [("byte_offsets", T.ArrayType(T.LongType())), ("char_offsets", T.ArrayType(T.LongType()))]
    if decoded:
        added += [("decoded", T.BinaryType())]
    docs = without(docs, [n for n, _ in added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value, pattern)
        table = byte_table(coder.tokenizer.get_vocab())
        length = np.array([len(x) for x in table], dtype=np.int64)
        for batch in slices(batches, text, TEXT_AT_ONCE):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            ids = coder.encode(texts)
            columns = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
            if offsets:
                at = [byte_offsets(x, length) for x in ids]
                chars = [char_offsets(t.encode(), o) for t, o in zip(texts, at, strict=True)]
                columns += [pa.array(at, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))]
            if decoded:
                columns += [pa.array(decoded_bytes(table, ids), pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[n for n, _ in added]])

    return docs.mapInArrow(lean(run), fields(docs, *added))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids_le", as_text: bool = False) -> DataFrame:
    """encoded with `decoded`: the bytes that the ids stand for, by the reversed byte table.

    With as_text the result is a string and bytes that are no UTF-8 become U+FFFD. Null ids give null, no ids an empty
    value; repeated rows stay, an empty table stays empty, a column `decoded` is replaced.
    """
    needs(encoded, ids)
    chars = byte_characters()
    shared = encoded.sparkSession.sparkContext.broadcast({"".join(map(chars.__getitem__, t)): r for t, r in read_ranks(ranks_path).items()})
    encoded = without(encoded, ["decoded"])
    kind, arrow = (T.StringType(), pa.string()) if as_text else (T.BinaryType(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(shared.value)
        for batch in slices(batches, ids, TEXT_AT_ONCE):
            out = decoded_bytes(table, batch.column(ids).to_pylist())
            if as_text:
                out = [None if x is None else x.decode(errors="replace") for x in out]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, arrow)], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(lean(run), fields(encoded, ("decoded", kind)))
