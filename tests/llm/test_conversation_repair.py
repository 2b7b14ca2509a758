"""Conversation repair against a search over edits, one conversation at a time."""

import heapq
import random
import zlib
from itertools import product

import pytest
from brute import sha, words

from panelspark.llm import conversation_repair as module
from panelspark.llm import queries

SF = "/root/testdata/sf0.001"
NEXT = {"": "sau", "s": "u", "u": "a", "a": "u"}


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        last = (text.rstrip(" \t\n\x0b\x0c\r") or " ")[-1]
        out.append("blank" if not words(text) else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, prune=True):
    """(cost, audit, repaired rows): edits by cost, then by name, until one leaves what is wanted."""
    faults = fault_of(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, state, out = heapq.heappop(heap)
        if prune and (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            return cost, audit, list(out)
        push = lambda more, name, step, to, row=None: heapq.heappush(heap, (cost + more, audit + name, i + step, to, out + ((row,) if row else ())))  # noqa: E731, B023
        for role in ("user", "assistant"):
            if role[0] in NEXT[state] and not (role == "assistant" and state != "u") and len(audit) < 3 * len(rows) + 4:
                push(5, "I", 0, role[0], (role, ""))
        if i == len(rows):
            continue
        role, text = rows[i]
        push(2, "D", 1, state)
        if faults[i] in ("blank", "duplicate"):
            continue
        cut = 5 if faults[i] == "truncated" else 0
        for to in ("user", "assistant", role):
            first = to[:1]
            fits = first == "s" and state == "" or first == "u" and state != "u" or first == "a" and state == "u"
            if fits and (to == role or to in ("user", "assistant")):
                push((0 if to == role else 1) + cut, "K" if to == role else "R", 1, first, (to, text))


def expected(rows):
    rows = [("  "[:1] if r is None else r, " " if t is None else t) for r, t in rows]
    faults = fault_of(rows)
    cost, audit, out = cheapest(rows)
    firsts = [r[:1] for r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(firsts, firsts[1:], strict=False))
    counts = [faults.count(x) for x in ("blank", "duplicate", "truncated")]
    return (*counts, illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out).encode()))


def by_conversation(rows):
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn, role, text))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0] is not None, x[0] or 0))] for c, v in held.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, kind string, cost int")


def found(df):
    assessed = module.assess(df)
    digest = {r.conv_id: r.repaired_sha256 for r in module.digests(module.repaired(df, assessed)).collect()}
    return {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digest.get(r.conv_id, sha(b""))) for r in assessed.collect()}


def made(seed, n, most):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut off", "", " \t", "Why? \n", "é", "a.b"]
    return [(c, k, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(texts) + rng.choice(["", f" {rng.randrange(99)}."])) for c in range(n) for k in range(rng.randrange(1, most))]


def test_edits_equal_the_search(spark):
    rows = made(1, 300, 14) + [(None, 1, "user", "Hi."), (None, None, "assistant", None), (1000, None, None, "x."), (1001, 5, "user", None), (1002, 1, "uncle", "Ok."), (1002, 2, "aunt", "Ok.")]
    assert found(frame(spark, rows).repartition(3)) == {c: expected(v) for c, v in by_conversation(rows).items()}
    assert module.assess(frame(spark, rows).limit(0)).count() == 0
    assert module.digests(module.repaired(frame(spark, rows).limit(0), module.assess(frame(spark, rows).limit(0)))).count() == 0


def test_short_sequences_without_pruning():
    """Every string of up to three symbols of some kinds: the search keeps all ways of editing."""
    texts = {"none": "Ok {}.", "blank": " ", "truncated": "cut {}"}
    grammar = module.Grammar(())
    for n in (1, 2, 3):
        for kinds in product([("system", "none"), ("user", "none"), ("assistant", "truncated"), ("user", "blank"), ("tool", "none")], repeat=n):
            rows = [(role, texts[f].format(k)) for k, (role, f) in enumerate(kinds)]
            string = "".join(chr(65 + 4 * ("sua".find(r[0]) % 4) + module.FAULTS.index(f or "none")) for (r, _), f in zip(rows, fault_of(rows), strict=True))
            assert grammar.repair(string) == cheapest(rows, prune=False)[:2]


def test_rules_are_shared_and_change_nothing(spark, monkeypatch):
    """Long conversations that repeat themselves, in pieces of many partitions."""
    monkeypatch.setattr(module, "SHORT", 8)
    cycle = [("user", "Q{}."), ("assistant", "A{}."), ("user", "R{}"), ("user", "S{}?"), ("tool", "T{}.")]
    rows = [(c, k, cycle[(k * k + c) % 5][0], cycle[(k * k + c) % 5][1].format(k)) for c in range(3) for k in range(400)]
    df = frame(spark, rows)
    assert found(df) == {c: expected(v) for c, v in by_conversation(rows).items()}
    strings = module.strings(df)
    work, rules = module.packed(strings.select("string").distinct())
    grammar, plain = module.Grammar(rules), module.Grammar(())
    sizes = [(len(r.string), len(r.packed)) for r in work.collect()]
    assert rules and all(p * 10 < n for n, p in sizes)
    assert all(grammar.repair(r.packed) == plain.repair(r.string) for r in work.collect())


def test_ropes_compare_as_strings():
    rng = random.Random(3)
    for _ in range(300):
        parts = [["".join(rng.choice("DIKR") for _ in range(rng.randrange(400))) for _ in range(4)] for _ in range(2)]
        parts[1][0] = parts[0][0]
        a, b = (module.Rope(p[0]) + (module.Rope(p[1]) + module.Rope(p[2])) + module.Rope(p[3]) for p in parts)
        assert (a < b, b < a, str(a)) == ("".join(parts[0]) < "".join(parts[1]), "".join(parts[1]) < "".join(parts[0]), "".join(parts[0]))


def test_a_text_longer_than_a_slice(spark):
    rows = [(1, 0, "user", "w " * 2_500_000 + "."), (1, 1, "assistant", "Ok."), (2, 0, "user", "w " * 2_500_000)]
    assert found(frame(spark, rows)) == {c: expected(v) for c, v in by_conversation(rows).items()}


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 1:
            text = ""
        if k == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if k == 4:
            role = "user"
        kept += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    return out


@pytest.mark.parametrize("nulls", [False, True])
def test_query_equals_the_contract(spark, tmp_path, nulls):
    source = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in source.select("conv_id", "turn", "role", "text").collect()]
    if nulls:
        rows = rows[:60] + [(None, 3, "user", "Hi."), (None, None, None, None), (9001, None, "assistant", None), (9002, None, None, "x")]
        spark.createDataFrame(rows, source.select("conv_id", "turn", "role", "text").schema).write.parquet(f"{tmp_path}/conversations.parquet")
    want = []
    for conv, kept in damage(rows).items():
        known = [t for t, _, _ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        values = expected([(r, t) for _, r, t in sorted(kept, key=lambda x: (x[0] is not None, x[0] or 0))]) if kept else (0, 0, 0, 0, 0, "", sha(b""))
        want.append((conv, gaps, *values))
    df = queries.QUERIES["op12_conversation_repair"](spark, str(tmp_path) if nulls else SF)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)
