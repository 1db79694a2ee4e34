"""Manifests and series derived from the driver's tables, in Spark's and in DuckDB's spelling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A snapshot: files from documents with symbolic links, their directories, and changes by residues of the id.
_SNAPSHOT = """
{n}_f AS (
  SELECT CASE WHEN doc_id % {move} = 5 THEN concat('moved/', p) ELSE p END AS path, 'FILE' AS path_type,
    CAST(CASE WHEN doc_id % {mode} = 6 THEN 33152 ELSE 33188 END AS BIGINT) AS mode,
    CAST(1500000000 + CASE WHEN doc_id % {time} = 1 THEN 60 ELSE 0 END AS BIGINT) AS mtime,
    CAST(CASE WHEN doc_id % {data} = 2 THEN size + 1 ELSE size END AS BIGINT) AS size,
    CAST(doc_id % 3 AS BIGINT) AS uid, CAST(doc_id % 2 AS BIGINT) AS gid, CAST(NULL AS {text}) AS link_dest,
    CASE WHEN doc_id % 29 = 3 THEN NULL WHEN doc_id % {data} = 2 THEN {sha}(concat(h, 'x'){bits}) ELSE h END AS sha256,
    CASE WHEN doc_id % {attr} = 1 THEN {sha}('example'{bits}) END AS xattr_hash
  FROM src WHERE doc_id % {drop} <> 3),
{n}_l AS (
  SELECT concat(source, '/', lang, '/', CAST(doc_id AS {text}), '.lnk') AS path, 'SYMLINK' AS path_type, CAST(41471 AS BIGINT) AS mode, CAST(1500000000 AS BIGINT) AS mtime, CAST(NULL AS BIGINT) AS size,
    CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid, concat(CAST(doc_id % {link} AS {text}), '.txt') AS link_dest, CAST(NULL AS {text}) AS sha256, CAST(NULL AS {text}) AS xattr_hash
  FROM src WHERE doc_id % 50 = 7),
{n}_d AS (
  SELECT DISTINCT path, 'DIR' AS path_type, CAST(16877 AS BIGINT) AS mode, CAST(1500000000 AS BIGINT) AS mtime, CAST(NULL AS BIGINT) AS size, CAST(0 AS BIGINT) AS uid, CAST(0 AS BIGINT) AS gid,
    CAST(NULL AS {text}) AS link_dest, CAST(NULL AS {text}) AS sha256, CAST(NULL AS {text}) AS xattr_hash
  FROM (SELECT source AS path FROM src UNION ALL SELECT concat(source, '/', lang) FROM src WHERE doc_id % {drop} <> 4 UNION ALL SELECT '.')),
{n} AS (SELECT * FROM {n}_f UNION ALL SELECT * FROM {n}_l UNION ALL SELECT * FROM {n}_d)"""
_CHANGES = {
    "m1": {"move": 1000003, "mode": 1000003, "time": 1000003, "data": 1000003, "attr": 23, "drop": 11, "link": 997},
    "m2": {"move": 13, "mode": 19, "time": 5, "data": 7, "attr": 31, "drop": 17, "link": 5},
    "m3": {"move": 13, "mode": 19, "time": 10, "data": 7, "attr": 31, "drop": 19, "link": 5},
}
SNAPSHOTS = [("2020-01-01-120000", "DONE", True), ("2020-01-02-120000", "DONE", False), ("2020-01-02-180000", "DELETED", True), ("2020-01-03-120000", "DONE", True)]
OF = {"m1": SNAPSHOTS[0][0], "m2": SNAPSHOTS[1][0], "m3": SNAPSHOTS[3][0]}


def _with(duck: bool) -> str:
    words = {"text": "VARCHAR", "sha": "sha256", "bits": ""} if duck else {"text": "STRING", "sha": "sha2", "bits": ", 256"}
    size = "strlen(text)" if duck else "octet_length(text)"
    src = "src AS (SELECT doc_id, source, lang, concat(source, '/', lang, '/', CAST(doc_id AS {text}), '.txt') AS p, {sha}(text{bits}) AS h, {size} AS size FROM documents)".format(size=size, **words)
    return ",\n".join([src, *(_SNAPSHOT.format(n=n, **c, **words) for n, c in _CHANGES.items())])


#: For the start of DuckDB statements: manifests m1 to m3, the series and its snapshots.
DUCK = (
    _with(True)
    + ",\nsnapshots AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', '{s}', {str(p).lower()})" for n, s, p in SNAPSHOTS)
    + ") t(name, state, pruneable)),\nseries AS ("
    + " UNION ALL ".join(f"SELECT '{name}' AS snapshot, * FROM {m}" for m, name in OF.items())
    + ")"
)


def manifest(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    body = f"WITH {_with(False)} SELECT *, CASE WHEN xattr_hash IS NOT NULL THEN array('example') ELSE array() END AS xattr_keys, false AS google_drive_remote_file FROM {which}"
    return spark.sql(body.replace("FROM documents", "FROM {documents}"), documents=docs)


def snapshots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SNAPSHOTS, "name string, state string, pruneable boolean")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [manifest(spark, sf_dir, m).withColumn("snapshot", F.lit(name)) for m, name in OF.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
