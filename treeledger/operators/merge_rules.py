"""Rule files of single directories: the deepest directory decides first."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.matchers import first_match
from ..functions.scalars import ancestors, glob_regex

Rules = list[tuple[str, str]]


def parse(directory: str, text: str) -> Rules:
    """Lines ``include PATTERN`` and ``exclude PATTERN``; blank lines and lines that start with a hash say
    nothing, and any other line is an error. A leading slash anchors at the directory of the file."""
    found: Rules = []
    for line in (text or "").splitlines():
        action, _, pattern = line.partition(" ")
        if not line.strip() or line.startswith("#"):
            continue
        if action not in ("include", "exclude") or not pattern.strip():
            raise ValueError(f"no rule: {line!r} in {directory}")
        pattern = pattern.strip()
        inside = pattern.startswith("/") and directory != "."
        found.append((action, f"/{directory}{pattern}" if inside else pattern))
    return found


def _compiled(files: DataFrame) -> DataFrame:
    """One row per directory: its rules as an array of (include, regex) in the order of the file."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rules = [[{"keep": a == "include", "regex": glob_regex(p)} for a, p in parse(d, t)] for d, t in zip(part["dir"], part["text"])]
            yield pd.DataFrame({"_dir": part["dir"], "_rules": rules})

    return files.select("dir", "text").mapInPandas(run, "_dir string, _rules array<struct<keep:boolean,regex:string>>")


def filter_dir_merge(manifest: DataFrame, files: DataFrame, *, before: Rules = (), after: Rules = ()) -> DataFrame:
    """Rows of a manifest that rules keep: static rules ``before``, those of the path's directories from the
    deepest to the root (``files``: dir, text), static rules ``after``; the first match decides, else the
    path stays. An excluded directory hides all below it. The root's rules, one file, are part of the
    expression, so that the join's keys are the directories that have rules of their own."""
    root = [r for f in files.where("dir = '.'").collect() for r in parse(".", f.text)]
    is_dir = F.col("path_type") == "DIR"
    parents = F.filter(ancestors(F.col("path")), lambda p: p != F.col("path"))
    above = manifest.select("path", is_dir.alias("_is_dir"), F.posexplode(parents).alias("_depth", "_dir"))
    subject = F.when(F.col("_is_dir"), F.concat("path", F.lit("/"))).otherwise(F.col("path"))
    own = above.join(_compiled(files.where("dir <> '.'")), "_dir").select("path", "_depth", F.try_element_at(F.filter("_rules", lambda r: F.rlike(subject, r["regex"])), F.lit(1))["keep"].alias("_keep"))
    deepest = own.where("_keep IS NOT NULL").groupBy("path").agg(F.max_by("_keep", "_depth").alias("_keep"))
    verdict = F.coalesce(first_match(F.col("path"), is_dir, list(before)), F.col("_keep"), first_match(F.col("path"), is_dir, [*root, *after]), F.lit(True)) | (F.col("path") == ".")
    decided = manifest.join(deepest, "path", "left").withColumn("_kept", verdict)
    gone = decided.where(is_dir & ~F.col("_kept")).select(F.col("path").alias("_dir"))
    hidden = above.join(gone, "_dir", "left_semi").select("path")
    return decided.where("_kept").join(hidden, "path", "left_anti").select(*manifest.columns)
