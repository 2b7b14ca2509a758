"""The n-gram Jaccard join against brute force over all pairs of sets."""

import random

import numpy as np
import pytest
from brute import shingle_set, smallest_reachable
from test_text_operators import HARD, frame, given

from panelspark.llm import jaccard_join
from panelspark.llm.simhash import shingle_hashes


def brute(rows, percent, width):
    sets = [shingle_set_of_ascii_lowered(t, width) for _, t in rows]
    least = smallest_reachable([(i, s) for (i, _), s in zip(rows, sets, strict=True)], lambda a, b: len(a & b) * 100 >= percent * len(a | b) > 0)
    return sorted(((i, len(s), c if s else i) for (i, _), s, c in zip(rows, sets, least, strict=True)), key=str)


def shingle_set_of_ascii_lowered(text, width):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return shingle_set_raw(lowered, width)


def shingle_set_raw(text, width):
    from brute import words

    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def found(df, percent, width):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.classes_of_near_sets(df, percent, width).collect()), key=str)


def families(seed, groups, most, vocabulary):
    """Texts of a base each, with words changed so that similarities lie on both sides of 0.9."""
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([4, 9, 12, 15, 25, 60, 150, 400, 900]))]
        for _ in range(rng.randrange(1, most)):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randrange(0, max(2, len(copy) // 25))):
                copy[k] = rng.choice([f"x{rng.randrange(30)}", copy[k].upper()])
            copy = copy[rng.randrange(2) :] if rng.random() < 0.3 else copy
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("percent", "width"), [(90, 3), (80, 5)])
def test_components_equal_brute_force(spark, percent, width):
    rows = families(3, 40, 9, 5000)
    assert found(frame(spark, rows).repartition(3), percent, width) == brute(rows, percent, width)


def test_hard_rows_and_given_texts(spark):
    rows = given(spark) + HARD + [(i, t) for i, t in HARD[:7]]
    assert found(frame(spark, rows).repartition(3), 90, 3) == brute(rows, 90, 3)
    assert found(frame(spark, rows).limit(0), 90, 3) == []
    with pytest.raises(ValueError):
        jaccard_join.classes_of_near_sets(frame(spark, rows), 70)


def test_tiles_that_the_centre_leaves_apart(spark, monkeypatch):
    """One family of 300 texts, most not near its base: blocks of outsiders meet cells of members."""
    monkeypatch.setattr(jaccard_join, "OUTSIDERS", 8)
    monkeypatch.setattr(jaccard_join, "MEMBERS", 16)
    rng, base, rows = random.Random(9), [f"w{k}" for k in range(120)], []
    for i in range(300):
        copy = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 7)):
            copy[k] = f"x{rng.randrange(8)}"
        rows.append((i, " ".join(copy)))
    want = brute(rows, 90, 3)
    assert 20 < len({c for _, _, c in want}) < 290
    assert found(frame(spark, rows), 90, 3) == want


def test_one_chain_and_a_text_longer_than_a_slice(spark):
    chain = [(i, " ".join(f"v{k}" for k in range(i * 5, i * 5 + 200))) for i in range(40)]
    rng = random.Random(2)
    long = [f"u{rng.randrange(10**9)}" for _ in range(450_000)]
    other = [w if k % 400 else "changed" for k, w in enumerate(long)]
    rows = [*chain, (50, " ".join(long)), (51, " ".join(other))]
    assert len(rows[-1][1]) > 4 << 20
    got = {i: c for i, _, c in found(frame(spark, rows), 90, 3)}
    assert got == {**{i: 0 for i in range(40)}, 50: 50, 51: 50}


def test_near_sets_share_a_tile_and_bitmaps_bound_the_overlap():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.choice([10, 11, 19, 40, 200, 1000, 3000])
        x = {rng.getrandbits(64) for _ in range(n)}
        gone = rng.sample(sorted(x), rng.randrange(0, n // 12 + 2))
        y = (x - set(gone)) | {rng.getrandbits(64) for _ in range(rng.randrange(0, n // 25 + 2))}
        p, q = (np.array(sorted(s), dtype=np.uint64) for s in (x, y))
        common = len(x & y)
        bound = jaccard_join.overlaps_at_most(*(np.frombuffer(jaccard_join.bitmap(s), np.uint64) for s in (p, q)), len(p), len(q))
        assert bound >= common
        if x != y and common * 100 >= 90 * len(x | y):
            assert set(jaccard_join.tiles(p, 90).tolist()) & set(jaccard_join.tiles(q, 90).tolist())


def test_shingles_are_those_of_the_fingerprint():
    assert len(np.unique(shingle_hashes(b"A b a B a b", 3))) == len(shingle_set("a b a b a b", 3)) == 2
