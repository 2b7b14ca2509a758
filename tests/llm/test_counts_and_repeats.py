"""Token counts and substring dedup against the library and plain Python."""

import random

import public_tokenizers
import sentencepiece
from brute import sha, substring_dedup
from test_text_operators import HARD, SF, by_row, frame, given, wanted

from panelspark.llm import queries, substring_dedup as module, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark, monkeypatch):
    random.seed(3)
    fuzz = [(1000 + k, "".join(random.choice(["a", "the", " ", "  ", "\n", "▁", "<s>", "<unk>", "<0x0A>", "é", "é", "🙂", "7", "...", " ", "　", "\t"]) for _ in range(80))) for k in range(300)]
    every = given(spark) + HARD + fuzz
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = wanted(every, [(len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for _, t in every])
    for share in (1 << 20, 50):  # nearly all hot, nearly all rare
        monkeypatch.setattr(token_counts, "HOT_SHARE", share)
        monkeypatch.setattr(token_counts, "LEAST", 2)
        got = token_counts.token_counts(frame(spark, every).repartition(3), MODEL)
        assert by_row(got, "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.token_counts(frame(spark, every).limit(0), MODEL).count() == 0


def check(spark, rows, length):
    df = module.repeats(frame(spark, rows).repartition(3), length)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed, sha(r.kept.encode())) for r in df.collect()), key=str)
    assert got == wanted(rows, substring_dedup([t for _, t in rows], length))


def test_substring_dedup(spark):
    rows = given(spark)
    check(spark, rows, 35)
    check(spark, rows + HARD + [(i, t) for i, t in rows[:5]], 35)  # repeated rows and ids
    random.seed(5)
    few = [(k, " ".join(random.choice("ab") for _ in range(random.randrange(60)))) for k in range(40)]
    check(spark, few, 10)
    check(spark, few, 3)
    assert module.repeats(frame(spark, rows).limit(0)).count() == 0


def test_spans_are_maximal_repeats(spark):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, f"x y {passage} z"), (2, f"{passage} q"), (3, "alone " * 3)]
    got = {r.doc_id: [tuple(x) for x in r.removed] for r in module.repeats(frame(spark, rows)).collect()}
    assert got == {1: [(2, 42)], 2: [(0, 40)], 3: []}


def test_queries_run(spark):
    for name in ("op4_token_counts", "op6_substring_dedup"):
        assert queries.QUERIES[name](spark, SF).count() == 200
