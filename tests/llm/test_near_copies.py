"""The near-dedup stage of the pipeline against brute-force similarity of shingles."""

import pytest
from brute import fingerprint, jaccard, shingle_set, smallest_reachable

import corpus_pipeline
from panelspark.llm import simhash

SF = "/root/testdata/sf0.001"


def five_word_jaccard(a, b):
    return jaccard(shingle_set(a), shingle_set(b))


def test_near_copies_by_brute_force_jaccard(spark):
    """Copies with words changed, to similarities of 0.6 to 1: the stage keeps one of each group that 0.8 connects."""
    import random

    rng = random.Random(5)
    rows = []
    for group in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randrange(0, max(1, len(copy) // 22))):
                copy[k] = f"x{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    marks = [(i, (shingle_set(t), fingerprint(t, 5))) for i, t in rows]
    shares = [jaccard(marks[i][1][0], marks[j][1][0]) for i in range(len(rows)) for j in range(i)]
    far = sum(0.8 <= s < 1 for s in shares)
    assert far > 30 and sum(0.5 < s < 0.8 for s in shares) > 20
    least = smallest_reachable(marks, lambda a, b: jaccard(a[0], b[0]) >= 0.8 or (a[1] ^ b[1]).bit_count() <= 2)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted({c for c in least})


def test_large_group_of_near_copies_without_a_common_member(spark):
    """40 texts, each near to the next only: one component, though no member is near to all."""
    texts = [" ".join(f"v{k}" for k in range(i * 6, i * 6 + 200)) for i in range(40)]
    assert five_word_jaccard(texts[0], texts[1]) > 0.9 and five_word_jaccard(texts[0], texts[9]) < 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF).collect()] == [0]


def test_large_bucket_that_its_centre_leaves_apart(spark):
    """300 changed copies of one text, most further than 0.8 from it, so the rest of a bucket is compared by rare shingles."""
    import random

    rng = random.Random(9)
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 300):
        copy = list(base)
        for k in rng.sample(range(120), rng.randrange(1, 7)):
            copy[k] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy)))
    sets = [(i, shingle_set(t)) for i, t in rows]
    least = smallest_reachable(sets, lambda a, b: jaccard(a, b) >= 0.8)
    direct = [jaccard(sets[0][1], s) >= 0.8 for _, s in sets]
    assert 0 < sum(direct) < 250
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(least))


def test_distances_that_balls_do_not_reach_are_refused(spark):
    fps = spark.createDataFrame([(0,), (0b1111,)], "fp long")
    assert [tuple(r) for r in simhash.links(fps, 4).collect()] == [(0, 0b1111)]
    for distance in (5, 6, -1):
        with pytest.raises(ValueError):
            simhash.links(fps, distance)
