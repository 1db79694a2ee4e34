"""Verification against older lists of MD5 sums, and names of checkpoint images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the names of checkpoint images.
IMAGE_NAME = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{6})(-manifest)?[.](sparseimage|img|luks.img)$"


def verify_md5(files: DataFrame, sums: DataFrame, *, ignore: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """One row (path, outcome) per file (path, md5, inode) and per sum (path, checksum) without a file.

    ``hit``: the inode is among ``seen`` (inode); ``ok`` and ``mismatch``: the sum, padded with zeros to 32
    digits, against the file's; ``ignored`` and ``missing``: no sum, and the path does or does not match
    ``ignore`` from its start; ``unverified``: a sum whose file is absent."""
    known = (seen.select("inode") if seen is not None else files.select("inode").limit(0)).where("inode IS NOT NULL").distinct().withColumn("_seen", F.lit(True))
    both = files.join(known, "inode", "left").select("path", "md5", "_seen", F.lit(True).alias("_file")).join(sums.select("path", "checksum"), "path", "full")
    ignored = F.lit(False) if ignore is None else F.col("path").rlike(f"^(?:{ignore})")
    padded = F.when(F.length("checksum") < 32, F.lpad("checksum", 32, "0")).otherwise(F.col("checksum"))
    outcome = F.when(F.col("_file").isNull(), "unverified").when(F.col("_seen"), "hit").when(F.col("checksum").isNull(), F.when(ignored, "ignored").otherwise("missing")).when(padded.eqNullSafe(F.col("md5")), "ok").otherwise("mismatch")
    return both.select("path", outcome.alias("outcome"))


def parse_image_name(path: Column) -> dict[str, Column]:
    """name, manifest_only and suffix of a checkpoint image; all null for other files."""
    base = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_extract(base, IMAGE_NAME, 1)
    other = name == ""
    return {
        "name": F.when(~other, name),
        "manifest_only": F.when(~other, F.regexp_extract(base, IMAGE_NAME, 2) != ""),
        "suffix": F.when(~other, F.regexp_extract(base, IMAGE_NAME, 3)),
    }


def list_images(paths: DataFrame) -> DataFrame:
    """Checkpoint images (path, name, manifest_only, suffix); evaluating two of one name is an error."""
    found = paths.select("path", *(c.alias(k) for k, c in parse_image_name(F.col("path")).items())).where("name IS NOT NULL")
    twice = found.groupBy("name").agg(F.count("*").alias("_n"), F.collect_list(F.struct("path", "manifest_only", "suffix")).alias("_rows"))
    checked = twice.withColumn("_rows", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate checkpoint "), "name")).cast("array<struct<path:string,manifest_only:boolean,suffix:string>>")).otherwise(F.col("_rows")))
    return checked.select("name", F.explode("_rows").alias("_row")).select("_row.path", "name", "_row.manifest_only", "_row.suffix")


def images_to_apply(images: DataFrame, series: DataFrame) -> DataFrame:
    """Images newer than the latest snapshot (name, state) that is DONE; a manifest alone cannot be applied,
    so evaluating one is an error."""
    latest = series.where("state = 'DONE'").agg(F.coalesce(F.max("name"), F.lit("")).alias("_latest"))
    newer = images.join(F.broadcast(latest), F.col("name") > F.col("_latest")).drop("_latest")
    return newer.withColumn("path", F.when(F.col("manifest_only"), F.raise_error(F.concat(F.lit("manifest only: "), "path")).cast("string")).otherwise(F.col("path")))
