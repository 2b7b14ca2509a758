"""Scans and sinks: delimited files, nested filings, membership strings, drifting columns, refreshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FACTS = "facts map<string, map<string, struct<units: map<string, array<struct<start: string, `end`: string, filed: string, form: string, fp: string, val: double>>>>>>"


def read_csv_indexed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header whose first column is a date."""
    return spark.read.schema(schema).csv(path, header=True)


def read_facts_json(spark: SparkSession, path: str) -> DataFrame:
    """(company, taxonomy, tag, unit, start, end, filed, form, fp, val), one document a company; a broken document is skipped."""
    docs = spark.read.schema(f"company string, {FACTS}").json(path)
    tags = docs.select("company", F.explode("facts").alias("taxonomy", "tags")).select("company", "taxonomy", F.explode("tags").alias("tag", "t"))
    units = tags.select("company", "taxonomy", "tag", F.explode("t.units").alias("unit", "rows"))
    flat = units.select("company", "taxonomy", "tag", "unit", F.explode("rows").alias("r")).select("company", "taxonomy", "tag", "unit", "r.*")
    return flat.withColumns({c: F.to_date(c) for c in ("start", "end", "filed")})


def read_delimited(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated text as strings, '' and NULL as null, malformed lines dropped."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep="\t", header=True, mode="DROPMALFORMED")
    return rows.select(*[F.when(~F.col(c).isin("", "NULL"), F.col(c)).alias(c) for c in columns])


def resolve_columns(df: DataFrame, wanted: dict[str, list[str]], fill: dict[str, object] | None = None) -> DataFrame:
    """The wanted columns, each under any of its names in any case; a missing one has its fill value or null."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for name, aliases in wanted.items():
        found = next((have[a.lower()] for a in (name, *aliases) if a.lower() in have), None)
        out.append((F.col(f"`{found}`") if found else F.lit((fill or {}).get(name))).alias(name))
    return df.select(*out)


def explode_membership(snaps: DataFrame) -> DataFrame:
    """(snap_date, ticker) of delimited lists: text before '-', '.' as '-', trimmed; blanks dropped."""
    each = snaps.select("snap_date", F.explode(F.split("tickers", ",")).alias("t"))
    ticker = F.trim(F.replace(F.split_part("t", F.lit("-"), F.lit(1)), F.lit("."), F.lit("-")))
    return each.select("snap_date", ticker.alias("ticker")).where("ticker <> ''")


def normalize_symbols(df: DataFrame, symbol: str, pattern: str = "^[A-Z]{2,5}(-[A-Z])?$") -> DataFrame:
    """Distinct symbols with '.' as '-' that match the pattern."""
    return df.select(F.replace(F.trim(symbol), F.lit("."), F.lit("-")).alias("symbol")).where(F.col("symbol").rlike(pattern)).distinct()


def to_long(wide: DataFrame, keys: list[str], name: str, value: str) -> DataFrame:
    """One row for each key and column; nulls stay."""
    return wide.unpivot(keys, [c for c in wide.columns if c not in keys], name, value)


def to_wide(long: DataFrame, keys: list[str], name: str, value: str, names: list) -> DataFrame:
    """One column for each of the given names; at a report's edge only."""
    return long.groupBy(*keys).pivot(name, names).agg(F.first(value))


def write_results(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None) -> None:
    """Df as files at the path, instead of what was there, in folders by the columns `by`."""
    df.write.mode("overwrite").partitionBy(*(by or [])).format(kind).options(**({"header": True} if kind == "csv" else {})).save(path)


def stale_keys(cached: DataFrame, key: str, date: str, requested_end: str, slack_days: int) -> DataFrame:
    """(key, last) of keys whose last date is over slack_days before the requested end."""
    last = cached.groupBy(key).agg(F.max(date).alias("last"))
    return last.where(F.col("last") < F.date_sub(F.lit(requested_end).cast("date"), slack_days))


def combine(frames: list[DataFrame], required: list[str]) -> DataFrame:
    """All rows of all frames by column name, less those with none of the required values."""
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out.dropna(how="all", subset=required)
