"""Quality rules as a ledger: each rule is evaluated once, its failure is a bit, policies are masks of bits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import needs, without

#: Patterns as SQL strings have them: ASCII blanks, and any other character.
BLANK, NOT_BLANK = r"[\\x20\\x09-\\x0D]+", r"[^\\x20\\x09-\\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_capital_runs")

#: Rule by bit: name and SQL condition of failure over the measurements.
RULES = {
    0: ("too_few_words", "n_words < 50"),
    1: ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    2: ("symbols", "10 * n_symbols > n_words"),
    3: ("repeated_lines", "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines"),
    4: ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    5: ("shouting", "n_words > 0 and 2 * n_capital_runs > n_words"),
    6: ("some_repeated_words", "100 * n_repeat_words > 20 * n_words"),
}
BASE = 0b11

#: Versions of the policy: the rules that reject a document.
POLICIES = {"base": BASE, "v1": 0b0001111, "v2": 0b0111111, "strict": 0b1111111}


def let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(hashes: str) -> str:
    """SQL: words in 3-word windows that occur twice or more, from an array of the windows' hashes.

    Windows are sorted by hash with their place; those next to an equal one are repeated; their places in
    order, each covers three words or as many as lie before the next. n log n in the text's length.
    """
    by_hash = f"sort_array(transform({hashes}, (h, i) -> struct(h as h, i as i)))"
    twice = "filter(s, (x, k) -> x.h = try_element_at(s, k + 2).h or (k > 0 and x.h = s[greatest(k - 1, 0)].h))"
    total = "aggregate(p, struct(0L as total, -3 as last), (a, i) -> struct(a.total + least(3, i - a.last) as total, i as last), a -> a.total)"
    return let("s", by_hash, let("p", f"sort_array(transform({twice}, x -> x.i))", total))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES, each a long. Only built-in functions.

    Words are runs of other than ASCII blanks; a null text is as empty: all measures 0. word_chars counts
    code points in words, n_symbols the characters #*$%&|<>, n_lines the lines that hold a word,
    n_dup_lines those of them equal to an earlier one, n_repeat_words the words in 3-word windows found
    twice or more in the text, n_capital_runs the runs of two or more letters A-Z.

    Repeated rows stay and are measured alike, texts of any length are measured whole, an empty table stays empty,
    columns of docs with the names of measures are replaced.
    """
    needs(docs, text)
    docs = without(docs, [*MEASURES, "_ps_text", "_ps_words", "_ps_lines", "_ps_windows"])
    one = docs.withColumn("_ps_text", F.coalesce(F.col(text), F.lit("")))
    two = one.withColumn("_ps_words", F.expr(rf"array_remove(split(_ps_text, '{BLANK}'), '')")).withColumn("_ps_lines", F.expr(rf"filter(split(_ps_text, '\n'), l -> l rlike '{NOT_BLANK}')"))
    hashes = "transform(_ps_words, w -> xxhash64(w))"
    windows = let("g", hashes, "transform(slice(g, 1, size(g) - 2), (x, i) -> xxhash64(x, g[i + 1], g[i + 2]))")
    three = two.withColumn("_ps_windows", F.expr(f"case when size(_ps_words) < 3 then array() else {windows} end"))
    counts = {
        "n_words": "size(_ps_words)",
        "word_chars": "length(array_join(_ps_words, ''))",
        "n_symbols": "regexp_count(_ps_text, '[#*$%&|<>]')",
        "n_dup_lines": "size(_ps_lines) - size(array_distinct(_ps_lines))",
        "n_lines": "size(_ps_lines)",
        "n_repeat_words": f"case when size(array_distinct(_ps_windows)) = size(_ps_windows) then 0L else {repeated_words('_ps_windows')} end",
        "n_capital_runs": "regexp_count(_ps_text, '[A-Z]{2,}')",
    }
    return three.withColumns({k: F.expr(v).cast("long") for k, v in counts.items()}).drop("_ps_text", "_ps_words", "_ps_lines", "_ps_windows")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with MEASURES and `failed`: bit i is set if rule i of RULES fails. Repeated rows stay, an empty table stays empty;
    nulls, long texts and columns with these names are as in `measured`."""
    bits = " | ".join(f"(case when {condition} then {1 << bit}L else 0L end)" for bit, (_, condition) in RULES.items())
    return without(measured(docs, text), ["failed"]).withColumn("failed", F.expr(bits))


def verdicts(kept: DataFrame, policy: str) -> DataFrame:
    """A ledger with `kept`: no rule of the policy, and none of the base, fails."""
    return without(kept, ["kept"]).withColumn("kept", F.col("failed").bitwiseAND(F.lit(POLICIES[policy] | BASE)) == 0)


def ablations(kept: DataFrame, policies: dict[str, int] | None = None) -> DataFrame:
    """(policy, rule, n_failed, n_only, n_rejected, n_rejected_without): for each policy and rule the documents
    that fail the rule, those that fail no other rule of the policy, those that the policy rejects, and
    those that it rejects without the rule. Documents are first counted by their bits, so at most
    2**len(RULES) rows meet the policies."""
    masks = (POLICIES if policies is None else policies).items()
    table = ", ".join(f"struct('{p}' as policy, {m}L as mask, {1 << b}L as bit, '{name}' as rule)" for p, m in masks for b, (name, _) in RULES.items() if m >> b & 1)
    counts = kept.groupBy("failed").agg(F.count(F.lit(1)).alias("n"))
    each = counts.select("failed", "n", F.explode(F.expr(f"array({table})")).alias("r")).select("failed", "n", "r.*")
    total = lambda condition: F.coalesce(F.expr(f"sum(case when {condition} then n end)"), F.lit(0)).cast("long")
    return each.groupBy("policy", "rule").agg(
        total("failed & bit <> 0").alias("n_failed"),
        total("failed & mask = bit").alias("n_only"),
        total("failed & mask <> 0").alias("n_rejected"),
        total("failed & mask & ~bit <> 0").alias("n_rejected_without"),
    )
