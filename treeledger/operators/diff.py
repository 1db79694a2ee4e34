"""Diffs of two manifests, verification, and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import itemize
from ..schema import COLUMNS, FLAGS


def check_unique(manifest: DataFrame) -> DataFrame:
    """Paths that occur more than once; empty for a valid manifest."""
    return manifest.groupBy("path").agg(F.count("*").alias("n")).where("n > 1")


def compare(new: DataFrame, old: DataFrame, match=None) -> DataFrame:
    """Full outer join on path with all flags. A matcher filters both inputs, as a filter on the joined key
    would stay above the join."""
    if match is not None:
        new, old = new.where(match(F.col("path"))), old.where(match(F.col("path")))
    n = new.select(F.col("path"), F.struct(*COLUMNS).alias("n"), F.lit(True).alias("in_new"))
    o = old.select(F.col("path"), F.struct(*COLUMNS).alias("o"), F.lit(True).alias("in_old"))
    joined = n.join(o, "path", "full_outer").withColumns({"in_new": F.coalesce("in_new", F.lit(False)), "in_old": F.coalesce("in_old", F.lit(False))})
    out = joined.withColumns(itemize.flags("n", "o", F.col("in_new"), F.col("in_old")))
    return out.withColumns({"path_type": F.coalesce("n.path_type", "o.path_type"), "link_dest": F.when(F.col("in_new"), F.col("n.link_dest")).otherwise(F.col("o.link_dest"))})


def diff(new: DataFrame, old: DataFrame, *, include_matching: bool = False, ignore_uid: bool = True, ignore_gid: bool = True, match=None) -> DataFrame:
    """Itemized changes: path, path_type, flags, code, link_dest."""
    out = compare(new, old, match)
    if not include_matching:
        out = out.where(itemize.has_diffs(ignore_uid, ignore_gid))
    return out.select("path", "path_type", *FLAGS, itemize.code().alias("code"), "link_dest")


def itemize_all(manifest: DataFrame) -> DataFrame:
    """Every path as a new one."""
    out = manifest.withColumns({f: F.lit(f == "new_path") for f in FLAGS})
    return out.select("path", "path_type", itemize.code().alias("code"))


def _bytes(*sizes: Column) -> Column:
    return F.greatest(*[F.coalesce(s, F.lit(0)) for s in sizes])


def diff_stats(new: DataFrame, old: DataFrame, match=None) -> DataFrame:
    """One row: total (with skipped), skipped, matched and mismatched paths with their bytes."""
    out = compare(new, old)
    taken = F.lit(True) if match is None else match(F.col("path"))
    bad, size = taken & itemize.has_diffs(), _bytes(F.col("n.size"), F.col("o.size"))
    good = taken & ~itemize.has_diffs()
    total = lambda c: F.coalesce(F.sum(F.when(c, size)), F.lit(0)).cast("long")
    return out.agg(F.count("*").alias("total"), F.count_if(~taken).alias("skipped"), F.count_if(good).alias("matched"), total(good).alias("matched_bytes"), F.count_if(bad).alias("mismatched"), total(bad).alias("mismatched_bytes"))


def verify(manifest: DataFrame, scan: DataFrame, *, checksum_all: bool = False, match=None) -> DataFrame:
    """What a scanned tree differs in from its manifest. A hash that is known on one side only counts as a
    difference if all content was hashed."""
    out = compare(scan, manifest, match)
    strict = F.col("in_new") & F.col("in_old") & ~F.col("n.sha256").eqNullSafe(F.col("o.sha256")) if checksum_all else F.lit(False)
    return out.where(itemize.has_diffs() | strict).select("path", itemize.code().alias("code"), itemize.severity().alias("severity"))


def verify_stats(manifest: DataFrame, scan: DataFrame) -> DataFrame:
    out = compare(scan, manifest)
    bad = itemize.has_diffs()
    size = F.coalesce("n.size", F.lit(0))
    return out.agg(F.count_if("in_new").alias("total"), F.coalesce(F.sum(F.when(F.col("in_new"), size)), F.lit(0)).cast("long").alias("total_bytes"), F.count_if(bad).alias("mismatched"), F.coalesce(F.sum(F.when(bad, _bytes(F.col("n.size"), F.col("o.size")))), F.lit(0)).cast("long").alias("mismatched_bytes"))
