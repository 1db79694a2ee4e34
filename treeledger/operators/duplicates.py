"""Duplicates and renames: files that share their content."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import itemize
from ..functions.scalars import similarity
from ..schema import COLUMNS

#: Candidates below this many are ranked, so many of each class are listed, and buckets of more
#: files of one size are not searched for renames.
RANK_BELOW, LISTED, SIZE_BUCKET = 10, 5, 10


def files(manifest: DataFrame, least: int = 1) -> DataFrame:
    return manifest.where((F.col("path_type") == "FILE") & (F.col("size") >= least))


def groups(manifest: DataFrame, key: str = "sha256", least: int = 1) -> DataFrame:
    """Files by content (or size): number, bytes and first path of each group."""
    return files(manifest, least).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("path").alias("first_path"))


def pairs(subjects: DataFrame, candidates: DataFrame, key: str = "sha256") -> DataFrame:
    """Each subject with every other path's candidate of equal key; ``duplicate`` if nothing but the path
    differs. The join is on the content alone, so AQE can split a hot one."""
    s = files(subjects).select(F.col(key), F.struct(*COLUMNS).alias("n"))
    c = files(candidates).select(F.col(key), F.struct(*COLUMNS).alias("o"))
    out = s.join(c, key).where("n.path != o.path").withColumns(itemize.flags("n", "o", F.lit(True), F.lit(True)))
    return out.select(F.col("n.path").alias("path"), F.col("o.path").alias("candidate"), F.col("n.sha256").eqNullSafe(F.col("o.sha256")).alias("same_content"), (~itemize.has_diffs()).alias("duplicate"), itemize.code("n.path_type").alias("code"))


def counts(found: DataFrame) -> DataFrame:
    """Per path: duplicates and similar files."""
    return found.groupBy("path").agg(F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("similar"))


def ranked(found: DataFrame, *, by_path_only: bool = False) -> DataFrame:
    """Candidates of each path by similarity of the paths, then by path; only where they are few."""
    own = W.partitionBy("path")
    few = found.withColumn("n", F.count("*").over(own)).where(F.col("n") < RANK_BELOW)
    ratio = F.lit(0.0) if by_path_only else similarity(F.col("path"), F.col("candidate"))
    return few.withColumn("ratio", ratio).withColumn("rank", F.row_number().over(own.orderBy(F.desc("ratio"), "candidate"))).drop("n")


def best(found: DataFrame, **options) -> DataFrame:
    """The most similar duplicate of each path."""
    own = W.partitionBy("path").orderBy("rank")
    return ranked(found, **options).where("duplicate").withColumn("k", F.row_number().over(own)).where("k = 1").select("path", F.col("candidate").alias("best"))


def top(found: DataFrame, **options) -> DataFrame:
    """The first LISTED duplicates and similar files of each path."""
    own = W.partitionBy("path", "duplicate").orderBy("rank")
    return ranked(found, **options).withColumn("k", F.row_number().over(own)).where(F.col("k") <= LISTED).select("path", "candidate", "duplicate", "k")


def renames_by_size(gone: DataFrame, scan: DataFrame, cap: int = SIZE_BUCKET) -> DataFrame:
    """For each file that went or changed: whether its size's bucket is too large to search, and how many
    others of the bucket have its content."""
    bucket = files(scan).groupBy("size").agg(F.count("*").alias("bucket"))
    g = files(gone).select("path", "size", "sha256").join(bucket, "size", "left").withColumn("bucket", F.coalesce("bucket", F.lit(0)))
    c = files(scan).select(F.col("size").alias("_size"), F.col("sha256").alias("_sha"), F.col("path").alias("candidate"))
    hit = g.join(c, (F.col("size") == F.col("_size")) & (F.col("sha256") == F.col("_sha")) & (F.col("path") != F.col("candidate")) & (F.col("bucket") <= cap), "left")
    return hit.groupBy("path", "bucket").agg(F.count("candidate").alias("renames"), F.min("candidate").alias("first")).withColumn("too_many", F.col("bucket") > cap)


def deletable(manifest: DataFrame, inside, source: DataFrame | None = None, *, allow_inside: bool = False, ignore=()) -> DataFrame:
    """Files inside the given paths that have a copy outside (or anywhere with ``allow_inside``): delete the
    duplicates, report the similar ones. ``ignore`` names flags that do not count."""
    s = files(manifest).where(inside(F.col("path"))).select("sha256", F.struct(*COLUMNS).alias("n"))
    c = files(source if source is not None else manifest)
    c = (c if allow_inside else c.where(~inside(F.col("path")))).select("sha256", F.struct(*COLUMNS).alias("o"))
    out = s.join(c, "sha256").where("n.path != o.path").withColumns(itemize.flags("n", "o", F.lit(True), F.lit(True)))
    out = out.withColumns({f: F.lit(False) for f in ignore}).withColumn("same", ~itemize.has_diffs())
    return out.groupBy(F.col("n.path").alias("path")).agg(F.max("same").alias("delete"), F.min(F.when(F.col("same"), F.col("o.path"))).alias("duplicate_of"), F.min("o.path").alias("similar_to"))
