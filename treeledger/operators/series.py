"""Operators over an ordered series of snapshots: neighbours, uniqueness, deduplication, pruning, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import itemize
from ..schema import COLUMNS


def neighbours(snapshots: DataFrame) -> DataFrame:
    """Each snapshot (name, state, pruneable) with the nearest DONE ones and its immediate successor.
    A series has one row per snapshot, so one window over all of them is bounded by their number."""
    order = W.orderBy("name")
    done = F.when(F.col("state") == "DONE", F.col("name"))
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(1, W.unboundedFollowing)
    return snapshots.withColumns({"prev": F.last(done, True).over(before), "next": F.first(done, True).over(after), "superseding": F.lead("name").over(order)})


def latest(snapshots: DataFrame) -> DataFrame:
    return snapshots.where("state = 'DONE'").agg(F.max("name").alias("latest"))


def prune_window(snapshots: DataFrame) -> DataFrame:
    """DONE snapshots after the last one that must stay."""
    done = snapshots.where("state = 'DONE'")
    kept = done.where("not pruneable").agg(F.max("name").alias("kept"))
    return done.crossJoin(kept).where("kept is null or name > kept").select("name")  # one row


def skipped_runs(snapshots: DataFrame, low: str, high: str) -> DataFrame:
    """Contiguous runs of snapshots outside of a range of names."""
    order = W.orderBy("name")
    out = ~F.col("name").between(low, high)
    runs = snapshots.withColumn("skipped", out).withColumn("run", F.sum((~F.col("skipped")).cast("int")).over(order))
    return runs.where("skipped").groupBy("run").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last")).drop("run")


def merge_plan(left: DataFrame, right: DataFrame) -> DataFrame:
    """For two series by name: merge what both have, retain or import what one has."""
    both = left.select("name", F.lit(True).alias("l")).join(right.select("name", F.lit(True).alias("r")), "name", "full_outer")
    return both.select("name", F.when(F.col("l") & F.col("r"), "merge").when(F.col("l"), "retain").otherwise("import").alias("action"))


def merge_conflicts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths that both manifests of a merged snapshot have, with differences."""
    out = left.select("snapshot", "path", F.struct(*COLUMNS).alias("n")).join(right.select("snapshot", "path", F.struct(*COLUMNS).alias("o")), ["snapshot", "path"])
    out = out.withColumns(itemize.flags("n", "o", F.lit(True), F.lit(True))).where(itemize.has_diffs())
    return out.select("snapshot", "path", itemize.code("n.path_type").alias("code"))


def with_previous(series: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Rows of every snapshot joined to the same path of the previous DONE one: all pairs of neighbours in
    one pass, as the pair is part of the key."""
    near = neighbours(snapshots).select("name", "prev")
    n = series.select(F.col("snapshot").alias("name"), "path", F.struct(*COLUMNS).alias("n")).join(near, "name")
    o = series.select(F.col("snapshot").alias("prev"), "path", F.struct(*COLUMNS).alias("o"), F.lit(True).alias("in_old"))
    out = n.join(o, ["prev", "path"], "left").withColumn("in_old", F.coalesce("in_old", F.lit(False)))
    return out.withColumns(itemize.flags("n", "o", F.lit(True), F.col("in_old")))


def unique(series: DataFrame, snapshots: DataFrame, *, use_prev: bool = True, use_next: bool = True) -> DataFrame:
    """Paths of each snapshot that neither neighbour holds without differences. The rows of a path meet once,
    in the order of their snapshots, of which there are few; the series is read and shuffled once."""
    near = neighbours(snapshots).select("name", "prev", "next", (F.col("state") == "DONE").alias("done"))
    rows = series.select(F.col("snapshot").alias("name"), "path", F.struct(*COLUMNS).alias("n")).join(F.broadcast(near), "name")  # one row per snapshot
    order = W.partitionBy("path").orderBy("name")
    held = F.when(F.col("done"), F.struct("name", "n"))
    rows = rows.withColumns({"before": F.last(held, True).over(order.rowsBetween(W.unboundedPreceding, -1)), "after": F.first(held, True).over(order.rowsBetween(1, W.unboundedFollowing))})
    for side, at, used in (("prev", "before", use_prev), ("next", "after", use_next)):
        if used:
            there = F.coalesce(F.col(f"{at}.name") == F.col(side), F.lit(False))
            rows = rows.withColumns({"there": there, "o": F.when(there, F.col(f"{at}.n"))})
            rows = rows.withColumns(itemize.flags("n", "o", F.lit(True), F.col("there"))).where(itemize.has_diffs())
            rows = rows.select("name", "path", "n", "prev", "next", "before", "after")
    return rows.select(F.col("name").alias("snapshot"), "path", F.col("n.path_type").alias("path_type"), F.coalesce("n.size", F.lit(0)).alias("size"))


def unique_stats(series: DataFrame, snapshots: DataFrame, **options) -> DataFrame:
    own = unique(series, snapshots, **options).groupBy("snapshot").agg(F.count("*").alias("unique_paths"), F.sum("size").alias("unique_bytes"))
    return series.groupBy("snapshot").agg(F.count("*").alias("total")).join(own, "snapshot", "left").select("snapshot", "total", F.coalesce("unique_paths", F.lit(0)).alias("unique_paths"), F.coalesce("unique_bytes", F.lit(0)).alias("unique_bytes"))


def dedup_plan(series: DataFrame, snapshots: DataFrame, *, least: int = 1, older_mtimes: bool = False) -> DataFrame:
    """Files of a snapshot that can link to a file of the previous one: the first candidate by path with
    equal content and no differences (or only an older time with ``older_mtimes``), else similar."""
    near = neighbours(snapshots).where("state = 'DONE' and prev is not null").select("name", "prev")
    big = series.where((F.col("path_type") == "FILE") & (F.col("size") >= least) & F.col("sha256").isNotNull())
    n = big.select(F.col("snapshot").alias("name"), "sha256", F.struct(*COLUMNS).alias("n")).join(near, "name")
    o = big.select(F.col("snapshot").alias("prev"), "sha256", F.struct(*COLUMNS).alias("o"))
    out = n.join(o, ["prev", "sha256"]).withColumns(itemize.flags("n", "o", F.lit(True), F.lit(True)))
    if older_mtimes:
        out = out.withColumn("time_diff", F.col("time_diff") & ~(F.col("o.mtime") < F.col("n.mtime")))
    same = ~itemize.has_diffs()
    return out.groupBy(F.col("name").alias("snapshot"), F.col("n.path").alias("path")).agg(F.min(F.when(same, F.col("o.path"))).alias("link_to"), F.max(same).alias("duplicate"), F.first("n.size").alias("size"))


def dedup_stats(series: DataFrame, snapshots: DataFrame, **options) -> DataFrame:
    return dedup_plan(series, snapshots, **options).groupBy("snapshot").agg(F.count_if("duplicate").alias("duplicates"), F.coalesce(F.sum(F.when(F.col("duplicate"), F.col("size"))), F.lit(0)).cast("long").alias("duplicate_bytes"), F.count_if(~F.col("duplicate")).alias("similar"))
