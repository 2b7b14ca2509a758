"""Operators against plain Python on given tables and on hard rows."""

import random

import public_tokenizers
import pytest
import tiktoken
from brute import bench_words, contamination, fingerprint, line_dedup, rules, sha, smallest_reachable
from pyspark.sql import functions as F

from panelspark.llm import byte_bpe, decontamination, line_dedup as lines_module, queries, quality_rules, simhash

SF = "/root/testdata/sf0.001"
HARD = [
    (1, None), (2, ""), (3, " \t\n\x0b"), (4, "one"), (5, "one two"), (6, "a b c a b c a b c"), (7, "x " * 30_000),
    (8, "É é 日本語 🙂🙂 ﬁ １２ x y　z"), (9, "a\r\nb\r\n\r\nc d\x1ce\x85f"), (10, "<|endoftext|> #*$%&|<> <s>"),
    (None, "one two"), (12, "l1 x\nl2 y\nl3 z\nl4 w\n\nl1 x\nl2 y\nl3 z"), (12, "l1 x\nl2 y\nl3 z\nl4 w\n\nl1 x\nl2 y\nl3 z"),
    (13, "l2 y\nl3 z\nl4 w\ntail"), (14, "ONE TWO"), (15, "aaaaaaaaaaa aaaaaaaaaaaaaaaaaaaaaa   \n\n   \t x  "), (16, "l1 x\nl2 y\nl3 z"), (17, "q\n" * 9),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "FP", t and t[:5], 3, 7, "x", [1]) for i, t in rows], "doc_id long, text string, FP string, `n words` string, n_hit int, _id int, hash string, at array<int>")


def given(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def rows(spark):
    return given(spark) + HARD


def by_row(df, *names):
    return sorted(((r.doc_id is not None, r.doc_id or 0, *[r[n] for n in names]) for r in df.collect()), key=str)


def wanted(rows, values):
    return sorted(((i is not None, i or 0, *v) for (i, _), v in zip(rows, values, strict=True)), key=str)


def test_byte_bpe_equals_tiktoken_and_round_trips(spark, rows):
    ranks, pattern = public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN
    own = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(ranks), special_tokens={})
    random.seed(1)
    fuzz = [(1000 + k, "".join(random.choice(["a", "aa", "e", "ee", " ", "  ", "\n", "'s", "é", "🙂", "7", "=", "==", "-"]) for _ in range(200))) for k in range(300)]
    every = rows + fuzz
    df = byte_bpe.encode(frame(spark, every), ranks, pattern, offsets=True, decoded=True)
    df = byte_bpe.decode(df.withColumnRenamed("decoded", "d"), ranks, as_text=True)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_tokens, sha(r.ids_le), bytes(r.d), r.decoded) for r in df.collect()), key=str)
    ids = [own.encode_ordinary(t or "") for _, t in every]
    want = wanted(every, [(len(x), sha(b"".join(i.to_bytes(4, "little") for i in x)), (t or "").encode(), t or "") for x, (_, t) in zip(ids, every, strict=True)])
    assert got == want
    one = [r for r in df.where("doc_id = 8").collect()][0]
    text = one.text.encode()
    assert one.byte_offsets[-1] == len(text) and one.char_offsets[-1] == len(one.text)
    assert all(len(text[:b].decode(errors="ignore")) == c for b, c in zip(one.byte_offsets, one.char_offsets, strict=True))


def test_quality_rules(spark, rows):
    df = quality_rules.ledger(frame(spark, rows))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_row(df, *names) == wanted(rows, [rules(t) for _, t in rows])
    table = {(r.policy, r.rule): r for r in quality_rules.ablations(df).collect()}
    bits = [r.failed for r in df.collect()]
    one = table["v1", "symbols"]
    assert one.n_failed == sum(b >> 2 & 1 for b in bits) and one.n_rejected == sum(b & 0b1111 != 0 for b in bits)
    assert one.n_only == sum(b & 0b1111 == 4 for b in bits) and one.n_rejected_without == sum(b & 0b1011 != 0 for b in bits)


def test_line_dedup(spark, rows):
    df = frame(spark, rows)
    hashes = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    distinct = [*dict.fromkeys(rows)]
    order = sorted(range(len(distinct)), key=lambda i: (distinct[i][0] is not None, distinct[i][0] or 0, hashes[distinct[i]]))
    each = dict(zip(distinct, line_dedup(distinct, order), strict=True))
    assert by_row(lines_module.dedup_lines(df), "n_lines", "n_removed", "text") == wanted(rows, [each[r] for r in rows])


def test_simhash(spark, rows):
    df = simhash.near_duplicates(frame(spark, rows), distance=2, width=3)
    prints = [fingerprint(t) for _, t in rows]
    least = smallest_reachable([(i, f) for (i, _), f in zip(rows, prints, strict=True)], lambda a, b: (a ^ b).bit_count() <= 2)
    got = by_row(df.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("f"), "component_id"), "f", "component_id")
    assert got == wanted(rows, [(f"{f:016x}", c) for f, c in zip(prints, least, strict=True)])
    kept = simhash.keep_one(frame(spark, rows), 2, 3)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for (i, _), c in zip(rows, least, strict=True) if i == c)


def test_components_of_chains(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1002, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert simhash.components(edges.limit(0)).count() == 0


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_links_connect_all_within_distance(spark, distance):
    random.seed(distance)
    base = [random.getrandbits(64) for _ in range(6)]
    values = {b ^ sum(1 << k for k in random.sample(range(64), random.randrange(5))) for b in base for _ in range(25)}
    signed = [v - (v >> 63 << 64) for v in values]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance)
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    want = smallest_reachable([(v, v) for v in signed], lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= distance)
    assert [roots.get(v, v) for v in signed] == want


def items(spark):
    given_items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    return given_items + [(900, "one two"), (901, ""), (902, None), (903, "x x x"), (904, "One, two!"), (None, "a"), (905, "b 1 2 3 4 5 6 7 8 9 10 11 12")]


def test_decontamination(spark, rows):
    bench = items(spark)
    rows = rows + [(5000, "a b 1 2 3 4 5 6 7 8 9 10 z b, 1 2 3 4 5 6 7 8 9 10 11 12!")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    counted = [(i, t) for i, t in bench if i is not None]
    want = wanted(rows, [contamination(t, counted) for _, t in rows])
    df = frame(spark, rows).repartition(3)
    assert by_row(decontamination.contamination(df, table), *names) == want
    blocked = decontamination.contamination(df, table, block_bytes=3000)
    assert by_row(blocked, *names) == want
    whole = decontamination.contamination(df, table).where("doc_id = 5000").collect()[0]
    assert whole.longest_match == 13 and [tuple(m) for m in whole.matches if m.item_id == "905"] == [("905", 0, 1, 11), ("905", 0, 13, 13)]
    assert [tuple(m) for m in blocked.where("doc_id = 5000").collect()[0].matches if m.item_id == "905"] == [("905", 0, 1, 11), ("905", 0, 13, 13)]
    kept = decontamination.clean(df, table)
    assert kept.columns == df.columns and kept.count() == sum(not w[-1] for w in want)
    assert bench_words("É-a") == ["É", "a"]
    named = table.select(F.concat(F.lit("q"), "item_id").alias("item_id"), "text")
    assert {x for r in decontamination.contamination(df, named).where("doc_id = 5000").collect() for x in [m.item_id for m in r.matches]} >= {"q905"}


def longest_common(w, items, window):
    """Words of the longest verbatim match of a document with an item, of whole windows only."""
    best = 0
    for _, text in items:
        o = bench_words(text)
        least = min(window, len(o))
        for i in range(len(w)):
            for j in range(len(o)):
                n = 0
                while i + n < len(w) and j + n < len(o) and w[i + n] == o[j + n]:
                    n += 1
                if least and n >= least and (len(o) >= window or n == len(o)):
                    best = max(best, n)
    return best


@pytest.mark.parametrize("window", [3, 4])
def test_longest_matches_by_brute_force(spark, window):
    """Few words, so that suffixes tie, end inside a stretch and meet neighbours on both sides."""
    rng = random.Random(window)
    texts = lambda n, most: [" ".join(rng.choice("abc") for _ in range(rng.randrange(most))) for _ in range(n)]
    docs, bench = list(enumerate(texts(40, 60))), list(enumerate(texts(12, 14)))
    table = spark.createDataFrame(bench, "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    for size in (1 << 20, 60):
        got = decontamination.contamination(df, table, window, size)
        assert by_row(got, *names, "longest_match") == wanted(docs, [(*contamination(t, bench, window), longest_common(bench_words(t), bench, window)) for _, t in docs])
    for r in got.collect():
        for m in r.matches:
            item = bench_words(dict(bench)[int(m.item_id)])
            assert item[m.item_word : m.item_word + m.n_words] == bench_words(r.text)[m.doc_word : m.doc_word + m.n_words]


def test_shared_header_costs_no_pairs(spark):
    """One header 50 times in a document and in 2,000 items: matches grow with the document only."""
    header = "the following are multiple choice questions with answers about a topic"
    table = spark.createDataFrame([(k, f"{header} q{k}") for k in range(2000)], "item_id long, text string")
    df = spark.createDataFrame([(1, " x ".join([header] * 50))], "doc_id long, text string")
    r = decontamination.contamination(df, table).collect()[0]
    assert (r.n_items, r.n_hit, r.longest_match, len(r.matches)) == (2000, 550, 11, 50)


def test_empty_tables(spark):
    df, bench = frame(spark, HARD).limit(0), spark.createDataFrame([], "item_id long, text string")
    assert quality_rules.ledger(df).count() == lines_module.dedup_lines(df).count() == simhash.near_duplicates(df).count() == 0
    assert decontamination.contamination(df, bench).count() == 0
    assert decontamination.contamination(frame(spark, HARD), bench).where("contaminated or n_hit > 0").count() == 0
    assert byte_bpe.encode(df, public_tokenizers.path(queries.RANKS), public_tokenizers.PATTERN).count() == 0


def thue_morse(n, flip):
    return "".join("ab"[(bin(k).count("1") + flip) % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_of_one_pattern_and_its_complement_differ(spark, n):
    """A word of two letters in Thue-Morse order and its complement: no polynomial modulo 2**64 tells them apart."""
    words, other = [f"w{k}" for k in range(9)], [thue_morse(n, 0), thue_morse(n, 1)]
    docs = spark.createDataFrame([(k, " ".join([w, *words])) for k, w in enumerate(other)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join([other[0], *words]))], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in decontamination.contamination(docs, bench).collect()} == {0: (10, 1, True), 1: (0, 0, False)}
    from panelspark.llm import substring_dedup

    longer = spark.createDataFrame([(k, " ".join([w, *[f"w{j}" for j in range(34)]])) for k, w in enumerate(other)], "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.repeats(longer).collect()] == [0, 0]
    assert [r.n_removed for r in substring_dedup.repeats(longer.union(longer.where("doc_id = 0"))).orderBy("doc_id").collect()] == [35, 35, 0]


def test_texts_and_items_longer_than_a_slice(spark):
    rng = random.Random(11)
    long = " ".join(f"u{rng.randrange(10**9)}" for _ in range(450_000))
    item = " ".join(long.split()[200_000:200_300])
    assert len(long) > 4 << 20
    docs = spark.createDataFrame([(1, long), (2, "a b c " + item), (3, "a b c")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items, r.longest_match) for r in decontamination.contamination(docs, spark.createDataFrame([(7, item), (8, "q " * 30)], "item_id long, text string")).collect()}
    assert got == {1: (300, 1, 300), 2: (300, 1, 300), 3: (0, 0, 0)}
