"""Ranked lexical search against the score's definition over all pairs."""

import math
import random
import re
from collections import Counter

import pytest
from test_text_operators import HARD, frame, given

from panelspark.llm import lexical_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    held = [(i, Counter(terms(t))) for i, t in docs]
    sizes = [sum(c.values()) for _, c in held]
    n_docs, n_terms = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, c), n in zip(held, sizes, strict=True):
            if n:
                m = 100 - 75 + 75 * n * n_docs // n_terms
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m)) for w in terms(text) if c[w])
                scores += [(-s, doc is None, doc or 0)] if s > 0 else []
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "item_id long, text string, doc_id string, rank int")


def found(docs, items, top):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in lexical_search.search(docs, items, top).collect()), key=str)


LONG = " ".join(f"t{k}" for k in range(150))
ITEMS = [(1, "one two"), (2, None), (3, ""), (4, "One one ONE x"), (4, "a b c"), (None, "日本語 é"), (6, "zzz"), (7, "l1 X l2 y l3 z l4 w"), (8, LONG)]


def test_search_equals_the_definition(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"t{k}" for k in range(150)] + ["one", "two", "x", "É", "日本語", "7"]
    made = [(100 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 5, 40, 300])))) for k in range(400)]
    docs = given(spark) + HARD + made + made[:30]  # ties and repeated rows
    items = ITEMS + [(20 + k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 12, 90])))) for k in range(30)]
    want = brute(docs, items, 10)
    assert found(frame(spark, docs).repartition(3), items_of(spark, items), 10) == want
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 900)  # several blocks of items
    monkeypatch.setattr(lexical_search, "PIECE_BYTES", 50)
    assert found(frame(spark, docs).repartition(2), items_of(spark, items), 10) == want
    assert found(frame(spark, docs), items_of(spark, items[:9]), 3) == brute(docs, items[:9], 3)


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), (HARD, []), ([], []), ([(1, None), (2, " ")], ITEMS)])
def test_nothing_to_search(spark, docs, items):
    got = lexical_search.search(frame(spark, docs), items_of(spark, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_a_text_longer_than_a_slice(spark):
    docs = [(1, "alpha " + "filler " * 900_000 + "omega"), (2, "alpha omega"), (3, "beta")]
    assert found(frame(spark, docs), items_of(spark, [(1, "alpha omega"), (2, "filler")]), 10) == brute(docs, [(1, "alpha omega"), (2, "filler")], 10)


def test_masks_out_of_reach_are_not_evaluated(monkeypatch):
    """With a hundred documents that hold both terms, those of one term are never scored."""
    import numpy as np

    texts = [b"a b"] * 100 + [b"a c c c"] * 900 + [b"c"] * 2000
    queries = lexical_search.Queries([(1, "a b")])
    found = lexical_search.Postings(texts, queries.numbers)
    found.weighted(np.array([5, 50]), 3000, 5800)
    scored = []
    scores = lexical_search.Postings.scores
    monkeypatch.setattr(lexical_search.Postings, "scores", lambda self, docs, *a: scored.extend(docs.tolist()) or scores(self, docs, *a))
    best = found.search(*queries.parts[0], list(range(3000)), [], 10)
    assert [i for _, _, i in best] == list(range(10)) and sorted(scored) == list(range(100))
