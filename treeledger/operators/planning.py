"""Plans of changes to a tree: sync, checkpoint, apply, copy, rename. Plans only; nothing is carried out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import itemize
from ..functions.matchers import match_prefix
from ..functions.scalars import ancestors
from ..schema import COLUMNS
from .diff import compare
from .duplicates import files


def sync_plan(basis: DataFrame, scan: DataFrame) -> DataFrame:
    """Changed paths of a scan against its basis, with renames: a removed file whose content the scan has
    elsewhere is renamed, otherwise deleted."""
    moved = files(scan).select("sha256", F.col("path").alias("to")).groupBy("sha256").agg(F.min("to").alias("to"), F.max("to").alias("to_last"))
    out = compare(scan, basis).where(itemize.has_diffs())
    out = out.join(moved, F.col("delete_path") & (F.col("o.sha256") == F.col("sha256")) & (F.coalesce(F.col("o.size"), F.lit(0)) >= 1), "left")
    action = F.when(F.col("new_path"), "add").when(F.col("delete_path"), F.when(F.col("to").isNotNull(), "renamed").otherwise("delete")).otherwise("update")
    return out.select("path", action.alias("action"), itemize.code().alias("code"), F.col("to").alias("renamed_to"), F.when(F.col("in_new"), F.coalesce("n.size", F.lit(0))).otherwise(0).cast("long").alias("bytes"))


def sync_stats(basis: DataFrame, scan: DataFrame) -> DataFrame:
    plan = sync_plan(basis, scan)
    return plan.agg(F.count("*").alias("synced"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("synced_bytes"), F.count_if(F.col("action") == "renamed").alias("renamed"), F.count_if(F.col("action") == "delete").alias("deleted"))


def checkpoint_delta(basis: DataFrame, tree: DataFrame, *, checksum_all: bool = False) -> DataFrame:
    """Rows of the tree that a checkpoint stores: new or changed, with ``checksum_all`` also by hash."""
    strict = F.col("in_old") & ~F.col("n.sha256").eqNullSafe(F.col("o.sha256")) if checksum_all else F.lit(False)
    return compare(tree, basis).where(F.col("in_new") & (itemize.has_diffs() | strict)).select("n.*").select(*COLUMNS)


def apply_plan(tree: DataFrame, target: DataFrame, delta: DataFrame) -> DataFrame:
    """Actions that turn a tree into the target; files whose content the delta lacks are errors."""
    out = compare(target, tree).where(itemize.has_diffs())
    out = out.join(delta.select("path", F.lit(True).alias("held")), "path", "left")
    needs = F.col("in_new") & (F.col("path_type") == "FILE") & (F.col("new_path") | F.col("checksum_diff") | F.col("size_diff"))
    action = F.when(F.col("delete_path"), "delete").when(needs & F.col("held").isNull(), "error").when(F.col("new_path"), "create").otherwise("change")
    return out.select("path", action.alias("action"), itemize.code().alias("code"))


def copy_plan(selected: DataFrame, previous: DataFrame) -> DataFrame:
    """How each row of a new snapshot comes about: a link to the same path or to a copy elsewhere in the
    previous snapshot, a copy from it, or a copy of the source."""
    same = compare(selected, previous).where("in_new").withColumn("same", F.col("in_old") & ~itemize.has_diffs())
    dup = files(selected).select("sha256", F.struct(*COLUMNS).alias("n")).join(files(previous).select("sha256", F.struct(*COLUMNS).alias("o")), "sha256").where("n.path != o.path")
    dup = dup.withColumns(itemize.flags("n", "o", F.lit(True), F.lit(True))).where(~itemize.has_diffs()).groupBy(F.col("n.path").alias("path")).agg(F.min("o.path").alias("other"))
    out = same.join(dup, "path", "left")
    is_file = F.col("path_type") == "FILE"
    action = F.when(F.col("same"), F.when(is_file, "link").otherwise("copy-from-last")).when(is_file & F.col("other").isNotNull(), "link-to-duplicate").otherwise("copy")
    return out.select("path", action.alias("action"), F.when(action == "link", F.col("path")).when(action == "link-to-duplicate", F.col("other")).alias("link_to"))


def reroot(manifest: DataFrame, root: str) -> DataFrame:
    """The subtree below ``root`` with paths relative to it; the root itself becomes ``.``."""
    if root == ".":
        return manifest
    inner = manifest.where(match_prefix(F.col("path"), [root]))
    return inner.withColumn("path", F.when(F.col("path") == root, ".").otherwise(F.substring("path", len(root) + 2, 1 << 30)))


def rebase(manifest: DataFrame, source: str, target: str) -> DataFrame:
    inner = manifest.where(match_prefix(F.col("path"), [source]))
    return inner.withColumn("path", F.concat(F.lit(target), F.substring("path", len(source) + 1, 1 << 30)))


def rename_paths(manifest: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """(path, new_path) of all rows; replacement in Java's notation."""
    return manifest.select("path", F.regexp_replace("path", F.lit("(?d)" + pattern), F.lit(replacement)).alias("new_path"))


def rename_collisions(renamed: DataFrame) -> DataFrame:
    """Renamed rows whose new path another row has: one that stays or comes later in path order, or an
    earlier one's new path. Rows are read once: what each place gets, and who is there, meet by the place."""
    gets = renamed.where("path != new_path").select(F.col("new_path").alias("place"), F.col("path").alias("mover"))
    there = renamed.select(F.col("path").alias("place"), F.lit(None).cast("string").alias("mover"), F.lit(True).alias("held"), (F.col("path") != F.col("new_path")).alias("leaves"))
    places = gets.withColumns({"held": F.lit(False), "leaves": F.lit(False)}).unionByName(there).groupBy("place").agg(F.min("mover").alias("first"), F.max("held").alias("held"), F.max("leaves").alias("leaves"))
    hit = gets.join(places.where("first is not null"), "place")
    taken = F.col("held") & ~(F.col("leaves") & (F.col("place") < F.col("mover")))
    return hit.where(taken | (F.col("first") < F.col("mover"))).select(F.col("mover").alias("path"), F.col("place").alias("new_path")).distinct()


def ancestor_closure(paths: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The paths, all their parents and the root, less what exists already."""
    out = paths.select(F.explode(ancestors(F.col("path"))).alias("path")).union(paths.limit(1).select(F.lit("."))).distinct()
    return out if existing is None else out.join(existing.select("path"), "path", "left_anti")


def restore_mtimes(tree: DataFrame, manifest: DataFrame) -> DataFrame:
    return tree.select("path", F.col("mtime").alias("old")).join(manifest.select("path", "mtime"), "path").where(~F.col("old").eqNullSafe(F.col("mtime")))


def patch(manifest: DataFrame, column: str, wrong: int, right: int) -> DataFrame:
    return manifest.withColumn(column, F.when(F.col(column) == wrong, right).otherwise(F.col(column)))


def union_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").union(b.select("path")).distinct()


def reuse_hashes(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Hashes of files whose (dev, ino) was hashed before."""
    return scan.join(known.groupBy("dev", "ino").agg(F.min("sha256").alias("known")), ["dev", "ino"], "left").withColumn("sha256", F.coalesce("sha256", "known")).withColumn("hit", F.col("known").isNotNull()).drop("known")
