"""Benchmark decontamination: suffix arrays of training shards, searched with every suffix of the test items.

A shard is a slice of a Spark partition, held in one Python worker. Its suffix array has all its suffixes in order; each
test suffix is searched in it by halving, which gives all places of its window, the longest verbatim matches and theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import joined, lean, needs, row_key, slices, without, word_hashes, words_at, written

#: Test items of a block take at most so many bytes of text, or are one item; and what an item counts besides its text.
BLOCK_BYTES, ITEM_BYTES = 4 << 20, 64
#: Blocks of items that are searched in one pass over the documents.
BLOCKS_A_PASS = 4

#: For each byte the lower-cased byte if words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ hold it, else 0.
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
LOWERED[[*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0
IN_WORD = LOWERED > 0
#: SQL: the number of such words of a text; A-Z need not be lowered to count them.
N_WORDS = r"cast(regexp_count(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as long)"

MATCH = T.StructType([T.StructField("item_id", T.StringType()), *[T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "n_words")]])
SPAN = T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())])
ADDED = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "matches"]


class Shard:
    """Texts as words, each word by its rank among the shard's, 0 behind each text, and the array of all suffixes in order.

    Suffixes are ordered by their first `depth` words, by doubling: ranks by so many words make ranks by twice as many, and
    only suffixes that are still tied are ordered anew.
    """

    def __init__(self, buffer: np.ndarray, ends: np.ndarray, depth: int):
        begin, end, self.first = words_at(buffer, ends, IN_WORD)
        self.alphabet, rank = np.unique(word_hashes(LOWERED[buffer], begin, end, 11), return_inverse=True)
        text = np.repeat(np.arange(len(ends) - 1), np.diff(self.first))
        #: Words of all texts in a row, one place later for each text before.
        self.words = np.zeros(len(begin) + len(ends), dtype=np.int64)
        self.words[np.arange(len(begin)) + text] = rank + 1
        self.text = np.full(len(self.words), len(ends) - 1)
        self.text[np.arange(len(begin)) + text] = text
        n, done = len(self.words), 1
        self.order = np.argsort(self.words, kind="stable")
        sorted_words = self.words[self.order]
        new = np.diff(sorted_words, prepend=-1) != 0
        #: Each suffix's place among the distinct ones so far: the slot where its run of equal ones begins.
        place = np.empty(n + 1, dtype=np.int64)
        place[n] = -1
        place[self.order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        while done < depth:
            tied = np.flatnonzero(~(new & np.append(new[1:], True)))
            if not len(tied):
                break
            mine = self.order[tied]
            key = place[mine] * (n + 1) + place[np.minimum(mine + done, n)] + 1
            by = np.argsort(key)
            key = key[by]
            self.order[tied] = mine = mine[by]
            first = np.diff(key, prepend=-1) != 0
            new[tied] = first
            place[mine] = np.maximum.accumulate(np.where(first, tied, 0))
            done *= 2

    def bound(self, low: np.ndarray, high: np.ndarray, depth: int, word: np.ndarray, above: bool) -> np.ndarray:
        """For each range of the array whose suffixes agree in `depth` words: where the suffixes begin whose next word is not
        below `word`, or is above it. All ranges are halved together."""
        low, high = low.copy(), high.copy()
        todo = np.flatnonzero(low < high)
        while len(todo):
            middle = (low[todo] + high[todo]) >> 1
            here = self.words[self.order[middle] + depth]
            right = here <= word[todo] if above else here < word[todo]
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
            todo = todo[low[todo] < high[todo]]
        return low


class TestSide:
    """A block of items: their words, and for each test suffix that begins with a whole window how long that window is."""

    __test__ = False

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.ids = [i for i, _ in items]
        buffer, ends = np.frombuffer(b"".join(t for _, t in items), dtype=np.uint8), np.cumsum([0, *[len(t) for _, t in items]])
        begin, end, self.first = words_at(buffer, ends, IN_WORD)
        self.hash = word_hashes(LOWERED[buffer], begin, end, 11)
        size = np.diff(self.first)
        self.depth = int(size.max(initial=0))
        self.item = np.repeat(np.arange(len(size)), size)
        #: First word, words to the item's end, and words of the window, of each test suffix.
        at = np.arange(len(self.hash))
        left, length = self.first[1:][self.item] - at, np.minimum(size, window)[self.item]
        whole = left >= length
        self.at, self.left, self.length = at[whole], left[whole], length[whole]


def shard_matches(test: TestSide, shard: Shard) -> Iterator[tuple[int, list, list, list]]:
    """(text, hit spans, items, maximal matches) of each text of the shard with a window of an item.

    Every test suffix is searched in the array, a word deeper at a time; a range that is empty ends its search. Where
    a suffix has its window, its range holds all places of the window; from there on each range tells the
    suffixes in it how far they match, so each keeps its longest match. Test suffixes of one range are one search.
    """
    at, left, length = test.at, test.left, test.length
    rank = np.searchsorted(shard.alphabet, test.hash)
    known = shard.alphabet[np.minimum(rank, len(shard.alphabet) - 1)] == test.hash if len(shard.alphabet) else np.zeros(len(rank), dtype=bool)
    rank = np.where(known, rank + 1, -1)
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(shard.order))
    size, place, depth = np.zeros(len(shard.words), dtype=np.int64), np.zeros(len(shard.words), dtype=np.int64), 0
    items_of: list[np.ndarray] = []
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at):
        # One search for all test suffixes of one range with one next word; ranges of one depth are apart or equal.
        word = rank[at + depth]
        keep = word > 0
        at, left, length, low, high, word = (x[keep] for x in (at, left, length, low, high, word))
        if not len(at):
            break
        _, one, many = np.unique(low * (len(shard.alphabet) + 1) + word, return_index=True, return_inverse=True)
        least, most = (shard.bound(low[one], high[one], depth, word[one], above)[many] for above in (False, True))
        keep = least < most
        at, left, length, low, high = (x[keep] for x in (at, left, length, least, most))
        depth += 1
        deep = depth >= length
        ranges, first, number = np.unique(low[deep], return_index=True, return_inverse=True)
        tests, upto = at[deep], high[deep][first]
        for k in range(len(ranges)):
            places = shard.order[ranges[k] : upto[k]]
            size[places], place[places] = depth, tests[first[k]]
        new = depth == length[deep]
        by = np.argsort(number[new], kind="stable")
        held, owners = number[new][by], test.item[tests[new][by]]
        for k in np.unique(held).tolist():
            found.append((shard.order[ranges[k] : upto[k]], np.full(upto[k] - ranges[k], len(items_of))))
            items_of.append(np.unique(owners[np.searchsorted(held, k) : np.searchsorted(held, k, side="right")]))
        on = left > depth
        at, left, length, low, high = (x[on] for x in (at, left, length, low, high))
    if not found:
        return
    hit, window = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(shard.text[hit], kind="stable")
    hit, window = hit[order], window[order]
    text = shard.text[hit]
    for k in np.unique(text).tolist():
        a, b = np.searchsorted(text, k), np.searchsorted(text, k, side="right")
        base = int(shard.first[k]) + k
        mine = np.unique(hit[a:b])
        edge = np.zeros(int(shard.first[k + 1] - shard.first[k]) + 1, dtype=np.int64)
        np.add.at(edge, mine - base, 1)
        np.add.at(edge, mine - base + size[mine], -1)
        turns = np.flatnonzero(np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)).reshape(-1, 2)
        items = np.unique(np.concatenate([items_of[w] for w in np.unique(window[a:b]).tolist()]))
        before = np.where(mine > base, size[np.maximum(mine - 1, 0)], 0)
        top = mine[size[mine] >= np.maximum(before, 1)]
        owner = test.item[place[top]]
        matches = [(test.ids[o], int(p - test.first[o]), int(m - base), int(size[m])) for o, p, m in zip(owner.tolist(), place[top].tolist(), top.tolist(), strict=True)]
        yield k, turns.tolist(), sorted({test.ids[i] for i in items.tolist()}), matches


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """Distinct items (id as string, text), a block of at most block_bytes, or one item, at a time: the driver holds one. Null ids
    and null texts have no part."""
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text").distinct()
    block, size = [], 0
    for r in written(items).toLocalIterator():
        text = r.text.encode()
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.item_id, text))
        size += len(text) + ITEM_BYTES
    if block:
        yield block


def scan(keyed: DataFrame, shared: list, window: int) -> DataFrame:
    """(doc_id, _row, block, hits, items, matches) of the rows of keyed (doc_id, _row, text) that a window of the blocks' items touches;
    one pass over keyed for all the blocks, and written."""
    kinds = [pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), *[(n, pa.int64()) for n in ("item_word", "doc_word", "n_words")]]))]
    names = ["hits", "items", "matches"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = [TestSide(b.value, window) for b in shared]
        depth = max(t.depth for t in tests)
        for batch in slices(batches, "text"):
            shard = Shard(*joined(batch.column("text")), depth)
            for number, test in enumerate(tests):
                found = list(shard_matches(test, shard))
                if found:
                    rows = pa.array([f[0] for f in found])
                    values = [[{"begin": a, "end": b} for a, b in f[1]] for f in found], [f[2] for f in found], [[dict(zip(MATCH.names, m, strict=True)) for m in f[3]] for f in found]
                    columns = [batch.column("doc_id").take(rows), batch.column("_row").take(rows), pa.array([number] * len(found), pa.int32()), *map(pa.array, values, kinds)]
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_row", "block", *names])

    fields = [keyed.schema["doc_id"], keyed.schema["_row"], T.StructField("block", T.IntegerType()), *[T.StructField(n, T.ArrayType(t)) for n, t in zip(names, (SPAN, T.StringType(), MATCH), strict=True)]]
    found = written(keyed.mapInArrow(lean(run), T.StructType(fields)))
    for b in shared:
        b.destroy()
    return found


#: SQL: words in the union of an array of spans.
COVERED = "aggregate(array_sort(hits), struct(0L as total, 0L as last), (a, s) -> struct(a.total + greatest(0L, s.end - greatest(s.begin, a.last)) as total, greatest(a.last, s.end) as last), a -> a.total)"


def touched(docs: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """(doc_id, _row, hits, items, matches) once for each document that a window touches, over all blocks of items."""
    keyed = docs.select(*row_key(), "text")
    context = docs.sparkSession.sparkContext
    lists = ["hits", "items", "matches"]
    found = keyed.select("doc_id", "_row", F.lit(0).alias("block"), *[F.array().cast(T.ArrayType(t)).alias(c) for c, t in zip(lists, (SPAN, T.StringType(), MATCH), strict=True)]).limit(0)
    passes, shared = 0, []
    for block in (*blocks(benchmark, block_bytes), None):
        if block is not None:
            shared.append(context.broadcast(block))
        if shared and (block is None or len(shared) == BLOCKS_A_PASS):
            found = found.union(scan(keyed, shared, window).withColumn("block", F.col("block") + passes * BLOCKS_A_PASS))
            passes, shared = passes + 1, []
    # Rows equal in id and text are one document here: each block's first row of them stands for all.
    once = found.groupBy("doc_id", "_row", "block").agg(*[F.first(c).alias(c) for c in lists])
    return once.groupBy("doc_id", "_row").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in lists])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, longest_match and matches.

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered. A window is `window` consecutive
    words of an item; an item of fewer words, but not none, is one window. A document's word inside any
    occurrence of a window is hit. matches lists the document's maximal verbatim matches with one place of each
    in an item (ids as strings), longest_match is the length of the longest. A null, empty or blank text has no
    words; a text of any length is searched whole; items with null id or text take no part; without items, or
    without documents, nothing is hit; repeated rows stay, each with the same facts; columns of docs with the names of
    outputs are replaced.

    Each task orders all suffixes of a shard, a few MB of text, and searches every test suffix in them; hits, items and matches are read
    off the ranges that it finds. Items come in blocks of a bounded size: the driver holds one, a task BLOCKS_A_PASS; so many
    blocks are searched in one pass over docs, which writes only what it found.
    """
    needs(docs, "doc_id", "text")
    needs(benchmark, "item_id", "text")
    docs = without(docs, [*ADDED, "_ps_id", "_ps_hash", "_ps_matches"])
    ids = F.array_sort(F.array_distinct("items"))
    facts = touched(docs, benchmark, window, block_bytes).select(
        F.col("doc_id").alias("_ps_id"),
        F.col("_row").alias("_ps_hash"),
        F.expr(COVERED).alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        F.expr("array_max(transform(matches, m -> m.n_words))").alias("longest_match"),
        F.expr("array_sort(matches, (x, y) -> case when x.doc_word <> y.doc_word then int(sign(x.doc_word - y.doc_word)) when x.item_id < y.item_id then -1 when x.item_id > y.item_id then 1 else 0 end)").alias("_ps_matches"),
    )
    both = docs.join(facts, F.col("doc_id").eqNullSafe(F.col("_ps_id")) & (row_key()[1] == F.col("_ps_hash")), "left")
    return both.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.expr(N_WORDS).alias("n_words"),
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.expr("coalesce(n_hit, 0L) > 0").alias("contaminated"),
        F.coalesce("longest_match", F.lit(0).cast("long")).alias("longest_match"),
        F.coalesce("_ps_matches", F.array().cast(T.ArrayType(MATCH))).alias("matches"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that no benchmark window touches, with the columns of docs; nulls, empty texts and repeated
    rows as in `contamination`."""
    needs(docs, "doc_id", "text")
    needs(benchmark, "item_id", "text")
    bad = touched(docs, benchmark, window, block_bytes).select(F.col("doc_id").alias("_ps_id"), F.col("_row").alias("_ps_hash"))
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("_ps_id")) & (row_key()[1] == F.col("_ps_hash")), "left_anti")
