"""Line dedup by overlapping windows of three lines, found over the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import needs, row_key, without

ADDED = ("n_lines", "n_removed")


def line_windows(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, _row, at, w1, w2): every window of `width` consecutive lines with a word, by its first line's number.

    Two independent 64-bit hashes name a window: of 10**12 windows no two different ones are likely to agree in both.
    """
    lines = docs.select(*row_key(), F.expr(LINES).alias("lines")).where(F.size("lines") >= width)
    hashes = lines.select("doc_id", "_row", F.expr("transform(lines, l -> xxhash64(l))").alias("h"), F.expr("transform(lines, l -> xxhash64(1L, l))").alias("g"))
    joint = lambda x: ", ".join(f"{x}[i + {k}]" for k in range(width))
    windows = F.expr(f"transform(sequence(0, size(h) - {width}), i -> struct(xxhash64({joint('h')}) as w1, xxhash64({joint('g')}) as w2))")
    return hashes.select("doc_id", "_row", F.posexplode(windows).alias("at", "w")).select("doc_id", "_row", "at", "w.w1", "w.w2")


#: SQL: the lines of a text that hold a word.
LINES = r"filter(split(coalesce(text, ''), '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')"


def first_windows(docs: DataFrame, width: int) -> DataFrame:
    """(_ps_id, _ps_hash, _ps_firsts): for each document the windows that occur there first in the corpus.

    Every distinct window has exactly one first place, so a minimum by its hashes finds them; it is combined before
    the shuffle, so a window that a third of all documents share costs one row a task.
    """
    place = F.struct("doc_id", "_row", "at")
    first = line_windows(docs, width).groupBy("w1", "w2").agg(F.min(place).alias("p")).select("p.*")
    return first.groupBy("doc_id", "_row").agg(F.collect_set("at").alias("_ps_firsts")).select(F.col("doc_id").alias("_ps_id"), F.col("_row").alias("_ps_hash"), "_ps_firsts")


def dedup_lines(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs with their text less the lines that lie in later occurrences of a window, and with n_lines and n_removed.

    A window is `width` consecutive lines that hold a word, compared as they are; lines without a word are
    no part of windows and are never removed by themselves. The first occurrence, by doc_id, then a hash of the text, then line,
    stays; a line goes if any later occurrence covers it. Fewer lines than `width` make no window. Null text
    stays null with 0 lines. Rows equal in doc_id and text are one document: what one keeps, all keep; null
    doc_id comes first. Empty and blank texts have 0 lines and stay as they are, a text of any length is taken whole, an
    empty table stays empty. Columns of docs with the names of outputs are replaced. Only built-in functions.
    """
    needs(docs, "doc_id", "text")
    docs = without(docs, [*ADDED, "_ps_id", "_ps_hash", "_ps_firsts", "_ps_gone"])
    found = first_windows(docs.select("doc_id", "text"), width).hint("shuffle_hash")
    same = F.col("doc_id").eqNullSafe(F.col("_ps_id")) & (row_key()[1] == F.col("_ps_hash"))
    both = docs.join(found, same, "left")
    n = f"size({LINES})"
    later = f"case when {n} < {width} then array() else array_except(sequence(0, {n} - {width}), coalesce(_ps_firsts, array())) end"
    reach = ", ".join(f"x + {k}" for k in range(width))
    both = both.withColumn("n_lines", F.expr(n).cast("long")).withColumn("_ps_gone", F.expr(f"array_distinct(flatten(transform({later}, x -> array({reach}))))"))
    both = both.withColumn("n_removed", F.size("_ps_gone").cast("long"))
    # Line numbers count lines with a word only; the sorted numbers of those that stay are picked by place.
    kept_text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.expr(KEPT))
    return both.withColumn("text", kept_text).drop("_ps_id", "_ps_hash", "_ps_firsts", "_ps_gone")


def let(name: str, value: str, body: str) -> str:
    """SQL: body, in which name stands for the value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


#: SQL: the text less the lines whose number, among those with a word, is in _ps_gone; linear in the lines.
KEPT = let(
    "l",
    r"split(text, '\n')",
    let(
        "placed",
        r"filter(sequence(0, size(l) - 1), i -> l[i] rlike '[^\\x20\\x09-\\x0D]')",
        r"array_join(transform(array_except(sequence(0, size(l) - 1), transform(_ps_gone, g -> placed[g])), i -> l[i]), '\n')",
    ),
)
