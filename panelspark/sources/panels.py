"""Panels laid out for their windows and joins, and caches that are refreshed in part."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.sources.shared import shared_folder, written


def lay_out(panel: DataFrame, key: str = "asset", order: str = "i", buckets: int = 8, name: str | None = None) -> DataFrame:
    """The panel as a table in buckets of `key`, each one file sorted by key and order: windows and aggregations by key,
    and joins on it with tables of as many buckets, need no exchange (an as-of join still does: its union forgets buckets). The files lie in the shared folder; the table's name is in
    the session's catalog until `drop` is called. Choose about as many buckets as a stage has tasks."""
    session = panel.sparkSession
    name = name or f"panelspark_{uuid.uuid4().hex}"
    rows = panel.repartition(buckets, key)
    rows.write.bucketBy(buckets, key).sortBy(key, order).option("path", f"{shared_folder(session)}/{name}-{uuid.uuid4().hex}").format("parquet").saveAsTable(name)
    return session.table(name)


def drop(session: SparkSession, *names: str) -> None:
    """Forget tables that lay_out made; their files stay in the shared folder, which the cluster clears."""
    for name in names:
        session.sql(f"drop table if exists {name}")


class Cache:
    """A table of rows by key in folders of keys, of which a refresh writes only those that hold stale keys.

    Keys are dealt to `parts` folders by hash. A key is stale if its last date is over slack_days before the requested end,
    or if it is wanted and not there.
    """

    def __init__(self, session: SparkSession, path: str, key: str, date: str, parts: int = 16):
        self.session, self.path, self.key, self.date, self.parts = session, path, key, date, parts

    def placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int"))

    def rebuild(self, rows: DataFrame) -> None:
        """All rows anew."""
        self.placed(rows).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(self.path)

    def read(self) -> DataFrame:
        return self.session.read.parquet(self.path).drop("_part")

    def stale(self, wanted: DataFrame, requested_end: str, slack_days: int) -> DataFrame:
        """(key) of the wanted keys that are missing or end too early."""
        last = self.read().groupBy(self.key).agg(F.max(self.date).alias("_last"))
        met = wanted.select(self.key).distinct().join(last, self.key, "left")
        return met.where(F.col("_last").isNull() | (F.col("_last") < F.date_sub(F.lit(requested_end).cast("date"), slack_days))).select(self.key)

    def refresh(self, wanted: DataFrame, build: Callable[[DataFrame], DataFrame], requested_end: str, slack_days: int) -> int:
        """Rows of stale keys made anew by build(keys), the others as they are; returns the number of stale keys.

        Only folders that hold a stale key are written, each whole: their other keys' rows are copied. The new rows are
        written aside first, so a failed build changes nothing, and then take their folders' place; other folders' files stay
        untouched. A stale key for which build gives no rows keeps those that it had.
        """
        keys = written(self.placed(self.stale(wanted, requested_end, slack_days)))
        many = keys.count()
        if many:
            made = self.placed(build(keys.select(self.key)))
            old = self.session.read.parquet(self.path)
            kept = old.join(keys.select("_part").distinct(), "_part", "left_semi").join(made.select(self.key).distinct(), self.key, "left_anti")
            columns = [c for c in old.columns if c != "_part"] + ["_part"]
            rows = written(kept.select(columns).unionByName(made.select(columns)))
            rows.repartition("_part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)
        return many
