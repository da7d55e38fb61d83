"""Posting lifecycle: hashes, snapshot diff, closing, upserts, freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(columns: list[str]) -> Column:
    """sha256 of the columns as JSON in sorted order, nulls written out, moments as UTC."""
    fields = F.struct(*[F.col(c).alias(c) for c in sorted(columns)])
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"}), 256)


def last_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def snapshot_diff(stored: DataFrame, incoming: DataFrame, keys: list[str], complete: bool = True, digest: str = "content_hash", active: str = "is_active") -> DataFrame:
    """keys and change: NEW, REOPENED, UPDATED, UNCHANGED, CLOSED.

    Only a complete snapshot closes what it does not hold; rows that are
    absent and stay as they are do not appear.  Null keys are matched as
    values.
    """
    old = stored.select(*[F.col(k) for k in keys], F.col(digest).alias("__old"), F.col(active).alias("__active"), F.lit(True).alias("__had"))
    new = incoming.select(*keys, F.col(digest).alias("__new"), F.lit(True).alias("__has"))
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = old.alias("o").join(new.alias("n"), on, "full_outer").select(*[F.coalesce(f"o.{k}", f"n.{k}").alias(k) for k in keys], "__old", "__active", "__had", "__new", "__has")
    change = F.when(F.col("__had").isNull(), "NEW").when(F.col("__has").isNull(), F.when(F.col("__active") & F.lit(complete), "CLOSED")).when(~F.col("__active"), "REOPENED").when(~F.col("__old").eqNullSafe(F.col("__new")), "UPDATED").otherwise("UNCHANGED")
    return both.select(*keys, change.alias("change")).where("change is not null")


def apply_snapshot(stored: DataFrame, incoming: DataFrame, keys: list[str], observed: Column, complete: bool = True, touch_after: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """The next state of the table, and the changes.

    stored has the incoming columns, content_hash, is_active, first_seen_at,
    last_seen_at, closed_at; incoming has content_hash.  An empty snapshot is
    refused, as it would close everything; of equal keys the last by
    `position` counts.
    """
    if incoming.limit(1).count() == 0:
        raise ValueError("the snapshot is empty")
    if "position" in incoming.columns:
        incoming = last_of(incoming, keys, [F.desc("position")]).drop("position")
    changes = snapshot_diff(stored, incoming, keys, complete)
    content = [c for c in incoming.columns if c not in keys]
    s, i, c = stored.alias("s"), incoming.alias("i"), changes.alias("c")
    joined = c.join(s, keys, "full_outer").join(i, keys, "left")
    takes = F.col("c.change").isin("NEW", "REOPENED", "UPDATED")
    stale = F.col("s.last_seen_at") <= observed - F.expr(f"interval {touch_after}")
    state = joined.select(
        *keys,
        *[F.when(takes, F.col(f"i.{x}")).otherwise(F.col(f"s.{x}")).alias(x) for x in content],
        F.when(takes, True).when(F.col("c.change") == "CLOSED", False).otherwise(F.col("s.is_active")).alias("is_active"),
        F.when(F.col("c.change") == "NEW", observed).otherwise(F.col("s.first_seen_at")).alias("first_seen_at"),
        F.when(takes | ((F.col("c.change") == "UNCHANGED") & stale), observed).otherwise(F.col("s.last_seen_at")).alias("last_seen_at"),
        F.when(F.col("c.change") == "CLOSED", observed).when(takes, None).otherwise(F.col("s.closed_at")).alias("closed_at"),
    )
    return state, changes


def close_missing(stored: DataFrame, observed: DataFrame, keys: list[str], at: Column) -> DataFrame:
    """Active rows that were not observed, closed."""
    gone = stored.where("is_active").join(observed.select(*keys).distinct(), keys, "left_anti")
    return gone.withColumn("is_active", F.lit(False)).withColumn("closed_at", at)


def newer_wins(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Upsert in which the greatest version of a key stays; of equal versions the incoming one."""
    both = stored.withColumn("__in", F.lit(0)).unionByName(incoming.withColumn("__in", F.lit(1)))
    return last_of(both, keys, [F.col(version).desc_nulls_last(), F.desc("__in")]).drop("__in")


def known_children(children: DataFrame, parents: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose parent is known, and the number of the others."""
    return children.join(parents.select(key).distinct(), key, "left_semi"), children.join(parents.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("skipped"))


def upsert(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update: an incoming value that is not null replaces the stored one."""
    others = [c for c in stored.columns if c not in keys]
    return stored.alias("s").join(incoming.alias("i"), keys, "full_outer").select(*keys, *[F.coalesce(F.col(f"i.{c}"), F.col(f"s.{c}")).alias(c) for c in others])


def append_ledger(ledger: DataFrame, events: DataFrame, key: str = "dedupe_key") -> DataFrame:
    """The ledger with the events whose key it does not hold; of equal keys among the events one is taken."""
    fresh = events.dropDuplicates([key]).join(ledger.select(key), key, "left_anti")
    return ledger.unionByName(fresh.select(*ledger.columns))


def without_undone(events: DataFrame, id_col: str = "id", undo_col: str = "undo_of_id") -> DataFrame:
    """Events that no other event undoes, without the undoing ones."""
    undone = events.where(F.col(undo_col).isNotNull()).select(F.col(undo_col).alias("__u")).distinct()
    return events.where(F.col(undo_col).isNull()).join(undone, F.col(id_col) == F.col("__u"), "left_anti")


def changed_since(first: Column, updated: Column, closed: Column, moment: Column) -> Column:
    """Whether a row was first seen, updated or closed since a moment, the moment included."""
    at = lambda c: F.coalesce(c >= moment, F.lit(False))
    return at(first) | at(updated) | at(closed)


def is_stale(evaluated: Column, digest: Column, current_digest: Column, version: Column, current_version: Column) -> Column:
    """Whether an evaluation is missing, of other content or of another rule version."""
    return evaluated.isNull() | ~digest.eqNullSafe(current_digest) | ~version.eqNullSafe(current_version)


def freshness(change: Column, baseline: Column, posted: Column, observed: Column, days: int = 10, unknown_is_fresh: bool = False) -> Column:
    """fresh, unknown_age or too_old: reopened rows, and new ones after the baseline, are fresh whatever their date."""
    by_age = F.when(posted.isNull(), "fresh" if unknown_is_fresh else "unknown_age").when(posted >= observed - F.expr(f"interval {days} days"), "fresh").otherwise("too_old")
    return F.when(change == "REOPENED", "fresh").when((change == "NEW") & ~baseline, "fresh").otherwise(by_age)


def disposition(eligible: Column, verified: Column, fresh: Column) -> Column:
    return F.when(~eligible, "not_eligible").when(~verified, "not_verified").when(fresh == "fresh", "alert").otherwise("not_fresh")
