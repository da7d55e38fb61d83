"""Sinks: exports, bundles and saved aggregates, all written by Spark's own writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataline.session import Scratch


def export_csv(rows: DataFrame, path: str, dated: str = "applied_at") -> None:
    """Dated rows in ascending order, undated ones last, with a header."""
    rows.orderBy(F.col(dated).asc_nulls_last()).write.mode("overwrite").csv(path, header=True)


def export_json(owner: DataFrame, records: dict[str, tuple[DataFrame, str]], key: str, path: str) -> None:
    """One nested JSON line for each owner: every kind of record as an array under its name."""
    out = owner
    for name, (rows, by) in records.items():
        lists = rows.groupBy(F.col(by).alias(key)).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != by])).alias(name))  # one owner's own records
        out = out.join(lists, key, "left")
    out.write.mode("overwrite").json(path)


def export_bundle(tables: dict[str, tuple[DataFrame, Column]], since, until, path: str) -> None:
    """Rows of each table changed within [since, until], as gzipped JSON lines, and a line on the bundle."""
    some = None
    for name, (rows, moment) in tables.items():
        held = rows.where((moment >= F.lit(since)) & (moment <= F.lit(until)))
        held.write.mode("overwrite").json(f"{path}/{name}", compression="gzip")
        some = some or rows.sparkSession
    some.createDataFrame([(str(since), str(until), sorted(tables))], "since string, until string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/meta")


def export_inventory(rows: DataFrame, id_col: str, key: Column, path: str) -> None:
    """`id|md5(key)` lines, gzipped."""
    rows.select(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(key.cast("binary")))).write.mode("overwrite").text(path, compression="gzip")


def saved(rows: DataFrame, name: str) -> DataFrame:
    """A slow aggregate kept as a table in the shared folder."""
    return Scratch(rows.sparkSession, name).save(rows, name)
