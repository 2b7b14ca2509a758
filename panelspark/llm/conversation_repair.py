"""Conversation structure repair: cheapest edits by min-plus matrices over a grammar that all conversations share.

A turn is a symbol of its role and fault, a conversation a string of symbols. Pairs of symbols that recur become rules
(Re-Pair, a batch of pairs that cannot overlap at a time). Each rule has one matrix: for the state before and after it,
the least cost and, as a rope, the edits of that cost; it is the min-plus product of its parts' matrices. A
conversation is the product of what its string is left with. Equal strings are evaluated once.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import lean, needs, slices, written

#: Rounds of pairs that become rules, rules made in a round, and how often a pair must be found.
ROUNDS, RULES_A_ROUND, LEAST_USES = 12, 256, 2
#: Distinct pairs that a Python worker counts before it passes them on.
COUNTED = 400_000
#: Costs of edits: keep, change the role, delete, insert; and of a cut-off turn that stays.
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
FIRST_RULE = 0x100
BLANKS = " \t\n\x0b\x0c\r"
SHORT = 256
MODULUS, BASE = (1 << 61) - 1, 1_000_003


class Rope:
    """A string made of two parts, or a short text; equal sizes and hashes mean equal strings."""

    __slots__ = ("hash", "left", "right", "size", "text")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        if text is None:
            self.size = left.size + right.size
            self.hash = (left.hash * pow(BASE, right.size, MODULUS) + right.hash) % MODULUS
        else:
            self.size, self.hash = len(text), 0
            for c in text.encode():
                self.hash = (self.hash * BASE + c) % MODULUS

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.text is not None and other.text is not None and self.size + other.size <= SHORT:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __lt__(self, other: Rope) -> bool:
        a, b = [self], [other]
        while a and b:
            x, y = a.pop(), b.pop()
            if x is y or x.size == y.size and x.hash == y.hash:
                continue
            if x.text is None and (y.text is not None or x.size >= y.size):
                a += [x.right, x.left]
                b.append(y)
            elif y.text is None:
                b += [y.right, y.left]
                a.append(x)
            else:
                n = min(x.size, y.size)
                if x.text[:n] != y.text[:n]:
                    return x.text < y.text
                if x.size > n:
                    a.append(Rope(x.text[n:]))
                elif y.size > n:
                    b.append(Rope(y.text[n:]))
        return bool(b)

    def __str__(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.text is None:
                todo += [x.right, x.left]
            else:
                out.append(x.text)
        return "".join(out)


#: States: nothing yet, behind a system turn, behind a user turn, behind an assistant turn. A repair ends in the first or last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a turn of each role leads from each state.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
Entry = tuple[int, Rope]
Matrix = dict[int, dict[int, Entry]]


def put(row: dict[int, Entry], state: int, cost: int, edits: Rope) -> None:
    """Keep the cheaper entry; of two of one cost the one whose edits come first. Edits of one cost over the same turns
    are never one the beginning of the other (more insertions cost more), so what is first stays first."""
    held = row.get(state)
    if held is None or cost < held[0] or cost == held[0] and edits < held[1]:
        row[state] = (cost, edits)


def applied(row: dict[int, Entry], by: Matrix) -> dict[int, Entry]:
    out: dict[int, Entry] = {}
    for state, (cost, edits) in row.items():
        for to, (more, rest) in by[state].items():
            put(out, to, cost + more, edits + rest)
    return out


def product(x: Matrix, y: Matrix) -> Matrix:
    return {state: applied(row, y) for state, row in x.items()}


def insertions() -> Matrix:
    """Any number of inserted turns."""
    once: Matrix = {i: {i: (0, Rope(""))} for i in range(4)}
    for role in "ua":
        for i, j in STEPS[role].items():
            put(once[i], j, INSERT, Rope("I"))
    return product(product(once, once), once)


def turn(symbol: str) -> Matrix:
    """Insertions, then one edit of a turn."""
    kind, fault = divmod(ord(symbol) - ord("A"), 4)
    cut = CUT_OFF if FAULTS[fault] == "truncated" else 0
    edit: Matrix = {i: {i: (DELETE, Rope("D"))} for i in range(4)}
    if FAULTS[fault] in ("none", "truncated"):
        for role, cost, name in [(ROLES[kind : kind + 1], KEEP, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")]:
            for i, j in STEPS.get(role, {}).items():
                put(edit[i], j, cost + cut, Rope(name))
    return product(insertions(), edit)


class Grammar:
    """The matrices of all symbols and rules, made bottom-up."""

    held: dict[tuple, Grammar] = {}

    def __init__(self, rules: tuple[str, ...]):
        self.matrix = {chr(ord("A") + k): turn(chr(ord("A") + k)) for k in range(16)}
        for k, (left, right) in enumerate(rules):
            self.matrix[chr(FIRST_RULE + k)] = product(self.matrix[left], self.matrix[right])
        self.last = insertions()

    @classmethod
    def of(cls, rules: tuple[str, ...]) -> Grammar:
        if rules not in cls.held:
            cls.held = {rules: cls(rules)}
        return cls.held[rules]

    def repair(self, packed: str) -> tuple[int, str]:
        """Least cost and, of the edits of that cost, the first in order."""
        row = {START: (0, Rope(""))}
        for symbol in packed:
            row = applied(row, self.matrix[symbol])
        best: dict[int, Entry] = {}
        for state, entry in applied(row, self.last).items():
            if state in (START, ASSISTANT):
                put(best, 0, *entry)
        return best[0][0], str(best[0][1])


def faults(string: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated turns, and neighbours that are not su, ua or au."""
    counts = Counter(string)
    of = lambda fault: sum(n for c, n in counts.items() if (ord(c) - ord("A")) % 4 == fault)
    pairs = Counter(zip(string, string[1:], strict=False))
    role = lambda c: (ord(c) - ord("A")) // 4
    return of(1), of(2), of(3), sum(n for (x, y), n in pairs.items() if (role(x), role(y)) not in {(0, 1), (1, 2), (2, 1)})


def together(pairs: list[str]) -> list[str]:
    """Of the pairs, in order, those that can be replaced at one time: no symbol is the left of one and the right of another."""
    lefts, rights, chosen = set(), set(), []
    for p in pairs:
        alone = p[0] == p[1] and not {p[0]} & (lefts | rights)
        if alone or p[0] != p[1] and p[0] not in rights and p[1] not in lefts:
            chosen.append(p)
            lefts.add(p[0])
            rights.add(p[1])
            if len(chosen) == RULES_A_ROUND:
                break
    return chosen


def packed(strings: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
    """(string, packed) of distinct strings, and the rules: rule k, written chr(FIRST_RULE + k), is a pair of symbols.

    A round counts pairs, makes rules of the most frequent ones that cannot overlap and replaces them everywhere.
    Rounds and rules are bounded, so the rules fit a broadcast; symbols that no rule takes are evaluated one by one.
    """
    rules: list[str] = []
    work = written(strings.select("string", F.col("string").alias("packed")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["pair", "n"])
        for batch in batches:
            for text in batch.column("packed").to_pylist():
                seen.update(map("".join, zip(text, text[1:], strict=False)))
            if len(seen) > COUNTED:
                yield as_batch()
                seen.clear()
        yield as_batch()

    for _ in range(ROUNDS):
        counts = work.select("packed").mapInArrow(counted, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = counts.where(F.col("n") >= LEAST_USES).orderBy(F.col("n").desc(), "pair").limit(4 * RULES_A_ROUND).collect()
        chosen = together([r.pair for r in pairs])
        if not chosen:
            break
        names = {p: chr(FIRST_RULE + len(rules) + k) for k, p in enumerate(chosen)}
        rules += chosen

        def replaced(batches: Iterator[pa.RecordBatch], names: dict[str, str] = names) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text in batch.column("packed").to_pylist():
                    for pair in set(map("".join, zip(text, text[1:], strict=False))) & names.keys():
                        text = text.replace(pair, names[pair])
                    out.append(text)
                yield pa.RecordBatch.from_arrays([batch.column("string"), pa.array(out, pa.string())], names=["string", "packed"])

        work = written(work.mapInArrow(replaced, "string string, packed string"))
    return work, tuple(rules)


def evaluated(strings: DataFrame) -> DataFrame:
    """(string, blank, duplicate, truncated, illegal, cost, audit) of distinct strings of symbols."""
    work, rules = packed(strings)
    shared = strings.sparkSession.sparkContext.broadcast(rules)
    longs = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar.of(shared.value)
        for batch in slices(batches, "string"):
            found = [(*faults(s), *grammar.repair(p)) for s, p in zip(*[batch.column(c).to_pylist() for c in ("string", "packed")], strict=True)]
            columns = [pa.array([r[k] for r in found], pa.int64()) for k in range(5)] + [pa.array([r[5] for r in found], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("string"), *columns], names=["string", *longs, "audit"])

    return work.mapInArrow(lean(run), f"string string, {', '.join(f'{n} long' for n in longs)}, audit string")


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, same) of rows: null roles and texts are one space, `same` is a hash of both."""
    needs(rows, "conv_id", "turn", "role", "text")
    clean = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return clean.withColumn("same", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))


def in_order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("same").asc()]


def strings(rows: DataFrame) -> DataFrame:
    """(conv_id, string): the symbols of each conversation's rows, made of pieces of a range of turns each, so that no task
    holds a conversation's turns and a long one is dealt to many."""
    trimmed = F.rtrim("text", F.lit(BLANKS))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    light = turns(rows).select("conv_id", "turn", "role", "same", kind.alias("kind"), (trimmed == "").alias("blank"), F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"))
    again = F.expr("row_number() over (partition by conv_id, same order by turn asc nulls first) > 1")
    fault = F.when(F.col("blank"), 1).when(again, 2).when(~F.col("ended"), 3).otherwise(0)
    marked = light.select("conv_id", "turn", "role", "same", F.char(F.lit(65) + 4 * F.col("kind") + fault).alias("symbol"))
    order = [F.col("conv_id").asc_nulls_first(), *in_order()]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "symbol")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held, symbols, kind = TaskContext.get().partitionId(), None, [], None
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([piece], pa.int32()), pa.array(["".join(symbols)])], names=["conv_id", "piece", "string"])
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, symbol in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "symbol")], strict=True):
                if symbols and conv != held:
                    yield as_batch()
                    symbols = []
                held = conv
                symbols.append(symbol)
        if symbols:
            yield as_batch()

    schema = T.StructType([rows.schema["conv_id"], T.StructField("piece", T.IntegerType()), T.StructField("string", T.StringType())])
    pieces = ranged.mapInArrow(lean(run), schema)
    return pieces.groupBy("conv_id").agg(F.expr("array_join(transform(sort_array(collect_list(struct(piece, string))), x -> x.string), '')").alias("string"))


def assess(rows: DataFrame) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) for each conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, then by role and text. A row's first fault counts: blank (nothing but ASCII
    blanks), duplicate (an earlier row has its role and text), truncated (its last character that is no blank is none
    of .!?). illegal counts neighbours whose roles' first letters are not su, ua or au. cost is that of the cheapest
    edits that leave nothing, or user and assistant turns in alternation behind one system turn or none: keep (K), change the
    role to user or assistant (R), delete (D; blank and duplicate rows must go), insert an empty turn (I); audit holds
    the edits in order, the first in ASCII order of those that cost least. A null conv_id is a conversation too; null
    roles and texts are one space; repeated rows are duplicates; other columns are not used; an empty table gives no rows.
    Texts of any length are read once and whole.
    """
    found = written(strings(rows))
    each = written(evaluated(found.select("string").distinct()))
    return found.join(each, "string").drop("string")


def repaired(rows: DataFrame, assessed: DataFrame) -> DataFrame:
    """(conv_id, edit, role, text) of the repaired conversations: what `assess` found for rows, carried out.

    Rows of one conversation follow each other, in order, within a partition. Rows go by one at a time, so a
    conversation may be longer than memory; that its rows meet in one task is what their order in the output means.
    """
    head = assessed.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(b"").alias("same"))
    body = turns(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "same")
    order = [F.col("conv_id").asc_nulls_first(), "kind", *in_order()]
    dealt = head.union(body).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text")

    def edits(rows: Iterator[tuple]) -> Iterator[tuple]:
        audit, at, next_role = "", 0, ""

        def inserted(conv):
            nonlocal at, next_role
            while at < len(audit) and audit[at] == "I":
                yield conv, "I", next_role, ""
                at, next_role = at + 1, "assistant" if next_role == "user" else "user"

        held = None
        for conv, kind, role, text in rows:
            if kind == 0:
                yield from inserted(held)
                audit, at, next_role, held = text, 0, "user", conv
                continue
            yield from inserted(conv)
            edit, at = audit[at], at + 1
            if edit == "D":
                continue
            yield conv, edit, role if edit == "K" else next_role, text
            if not (edit == "K" and role[:1] == "s"):
                next_role = "assistant" if next_role == "user" else "user"
        yield from inserted(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def each():
            nonlocal kind
            for batch in slices(batches, "text"):
                kind = batch.schema.field("conv_id").type
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        def as_batch(out: list) -> pa.RecordBatch:
            kinds = (kind, pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=["conv_id", "edit", "role", "text"])

        out, size = [], 0
        for row in edits(each()):
            out.append(row)
            size += len(row[3]) + 64
            if size > 1 << 20:
                yield as_batch(out)
                out, size = [], 0
        if out:
            yield as_batch(out)

    return dealt.mapInArrow(lean(run), T.StructType([rows.schema["conv_id"], *[T.StructField(n, T.StringType()) for n in ("edit", "role", "text")]]))


def digests(turns_in_order: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what `repaired` returns: of its `role:text`, joined by newlines, in UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, digest, kind = None, None, None
        as_batch = lambda: pa.RecordBatch.from_arrays([pa.array([held], kind), pa.array([digest.hexdigest()])], names=["conv_id", "repaired_sha256"])
        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                line = f"{role}:{text}".encode()
                if digest is None or conv != held:
                    if digest is not None:
                        yield as_batch()
                    held, digest = conv, hashlib.sha256(line)
                else:
                    digest.update(b"\n" + line)
        if digest is not None:
            yield as_batch()

    return turns_in_order.mapInArrow(lean(run), T.StructType([turns_in_order.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())]))
