"""Named queries over manifests derived from the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import itemize, matchers, scalars
from ..operators import diff, duplicates, legacy, merge_rules, planning, renames, series
from ..sources import messages
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Manifests = tuple[DataFrame, DataFrame]


def _add(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql is not None:
        ORACLE_SQL[name] = f"WITH {X.DUCK}{sql}" if sql.startswith(",") else f"WITH {X.DUCK} {sql}"


def _two(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Old and new manifest to a result."""
    return lambda spark, sf: f(X.manifest(spark, sf, "m1"), X.manifest(spark, sf, "m2"))


def _one(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(X.manifest(spark, sf, "m2"))


def _flags_sql(n: str = "n", o: str = "o", n_in: str = "n.path IS NOT NULL", o_in: str = "o.path IS NOT NULL") -> str:
    both = f"({n_in}) AND ({o_in})"
    d = lambda c: f"{n}.{c} IS DISTINCT FROM {o}.{c}"
    kind = f"({n}.mode & 61440) <> ({o}.mode & 61440)"
    content = f"({n}.sha256 IS NOT NULL AND {o}.sha256 IS NOT NULL AND {n}.sha256 <> {o}.sha256)"
    return f"""({n_in}) AND NOT ({o_in}) AS new_path, coalesce({both} AND ({kind} OR {content}), false) AS replace_path, ({o_in}) AND NOT ({n_in}) AS delete_path,
      coalesce({both} AND ({kind} OR {content} OR {d('link_dest')}), false) AS checksum_diff, {both} AND {d('size')} AS size_diff, {both} AND {d('mtime')} AS time_diff,
      coalesce({both} AND ({n}.mode & 4095) <> ({o}.mode & 4095), false) AS permission_diff, {both} AND {d('uid')} AS uid_diff, {both} AND {d('gid')} AS gid_diff, {both} AND {d('xattr_hash')} AS xattr_diff"""


_HAS = "(new_path OR replace_path OR delete_path OR checksum_diff OR size_diff OR time_diff OR permission_diff OR xattr_diff)"
_CODE = """CASE WHEN delete_path THEN '*' || letter || '.delete' ELSE (CASE WHEN new_path OR replace_path THEN '>' ELSE '.' END) || letter || (CASE WHEN new_path THEN '+++++++' ELSE
  (CASE WHEN checksum_diff THEN 'c' ELSE '.' END) || (CASE WHEN size_diff THEN 's' ELSE '.' END) || (CASE WHEN time_diff THEN 't' ELSE '.' END) || (CASE WHEN permission_diff THEN 'p' ELSE '.' END)
  || (CASE WHEN uid_diff THEN 'o' ELSE '.' END) || (CASE WHEN gid_diff THEN 'g' ELSE '.' END) || (CASE WHEN xattr_diff THEN 'x' ELSE '.' END) END) END"""
_LETTER = "CASE path_type WHEN 'DIR' THEN 'd' WHEN 'SYMLINK' THEN 'L' ELSE 'f' END"
_SEVERITY = "CASE WHEN delete_path OR checksum_diff OR size_diff THEN 'red' WHEN new_path THEN 'green' WHEN time_diff OR permission_diff THEN 'yellow' WHEN xattr_diff THEN 'purple' ELSE 'none' END"
#: Change from m1 to m2: one row per path of either, with flags, sides and code.
_J = f""",
j0 AS (SELECT coalesce(n.path, o.path) AS path, coalesce(n.path_type, o.path_type) AS path_type, n.path IS NOT NULL AS in_new, o.path IS NOT NULL AS in_old, n.size AS n_size, o.size AS o_size, n.sha256 AS n_sha, o.sha256 AS o_sha,
  n.mtime AS n_mtime, o.mtime AS o_mtime, CASE WHEN n.path IS NOT NULL THEN n.link_dest ELSE o.link_dest END AS link_dest, {_flags_sql()} FROM m2 n FULL OUTER JOIN m1 o ON n.path = o.path),
j1 AS (SELECT *, {_LETTER} AS letter FROM j0), j AS (SELECT *, {_CODE} AS code, {_HAS} AS changed, {_SEVERITY} AS severity FROM j1)
"""
_FLAG_LIST = "new_path, replace_path, delete_path, checksum_diff, size_diff, time_diff, permission_diff, uid_diff, gid_diff, xattr_diff"
_FILES = "path_type = 'FILE' AND size >= 1"


def _pairs_sql(subjects: str, candidates: str) -> str:
    return f""",
q0 AS (SELECT n.path, o.path AS candidate, n.path_type, n.sha256 = o.sha256 AS same_content, {_flags_sql('n', 'o', 'true', 'true')} FROM {subjects} n JOIN {candidates} o ON n.sha256 = o.sha256 AND n.path <> o.path
  WHERE n.{_FILES.replace('AND ', 'AND n.')} AND o.{_FILES.replace('AND ', 'AND o.')}),
q1 AS (SELECT *, {_LETTER} AS letter FROM q0), q AS (SELECT *, {_CODE} AS code, NOT {_HAS} AS duplicate FROM q1)
"""


# --- diffs ---------------------------------------------------------------------------------------

_add("diff_paths", _two(lambda a, b: diff.diff(b, a)), _J + f"SELECT path, path_type, {_FLAG_LIST}, code, link_dest FROM j WHERE changed")
_add("diff_code", _two(lambda a, b: diff.diff(b, a, include_matching=True).select("path", "code")), _J + "SELECT path, code FROM j")
_add("diff_counting_owners", _two(lambda a, b: diff.diff(b, a, ignore_uid=False, ignore_gid=False).select("path", "code")), _J + "SELECT path, code FROM j WHERE changed OR uid_diff OR gid_diff")
_add("diff_severity", _two(lambda a, b: diff.compare(b, a).select("path", itemize.severity().alias("severity"))), _J + "SELECT path, severity FROM j")
_add("diff_stats", _two(lambda a, b: diff.diff_stats(b, a, lambda p: matchers.match_prefix(p, ["src1", "src2"]))), _J + """,
k AS (SELECT *, path IN ('src1', 'src2') OR starts_with(path, 'src1/') OR starts_with(path, 'src2/') AS taken, greatest(coalesce(n_size, 0), coalesce(o_size, 0)) AS b FROM j)
SELECT count(*) AS total, count(*) FILTER (NOT taken) AS skipped, count(*) FILTER (taken AND NOT changed) AS matched, CAST(coalesce(sum(b) FILTER (taken AND NOT changed), 0) AS BIGINT) AS matched_bytes,
  count(*) FILTER (taken AND changed) AS mismatched, CAST(coalesce(sum(b) FILTER (taken AND changed), 0) AS BIGINT) AS mismatched_bytes FROM k""")
_add("diff_scoped", _two(lambda a, b: diff.diff(b, a, match=lambda p: matchers.match_prefix(p, ["src1/en"])).select("path", "code")), _J + "SELECT path, code FROM j WHERE changed AND (path = 'src1/en' OR starts_with(path, 'src1/en/'))")
_add("itemize_all", _one(diff.itemize_all), f"SELECT path, path_type, '>' || {_LETTER} || '+++++++' AS code FROM m2")
_add("verify", _two(lambda a, b: diff.verify(a, b, checksum_all=True)), _J + "SELECT path, code, severity FROM j WHERE changed OR (in_new AND in_old AND n_sha IS DISTINCT FROM o_sha)")
_add("verify_stats", _two(diff.verify_stats), _J + "SELECT count(*) FILTER (in_new) AS total, CAST(coalesce(sum(coalesce(n_size, 0)) FILTER (in_new), 0) AS BIGINT) AS total_bytes, count(*) FILTER (changed) AS mismatched, CAST(coalesce(sum(greatest(coalesce(n_size, 0), coalesce(o_size, 0))) FILTER (changed), 0) AS BIGINT) AS mismatched_bytes FROM j")
_add("missing_paths", _two(lambda a, b: a.join(b, "path", "left_anti").select("path", "path_type")), "SELECT path, path_type FROM m1 WHERE path NOT IN (SELECT path FROM m2)")
_add("extra_paths", _two(lambda a, b: b.join(a, "path", "left_anti").select("path", "path_type")), "SELECT path, path_type FROM m2 WHERE path NOT IN (SELECT path FROM m1)")
_add("common_changed", _two(lambda a, b: diff.compare(b, a).where(F.col("in_new") & F.col("in_old") & itemize.has_diffs()).select("path", itemize.code().alias("code"))), _J + "SELECT path, code FROM j WHERE in_new AND in_old AND changed")
_add("union_paths", _two(planning.union_paths), "SELECT path FROM m1 UNION SELECT path FROM m2")
_add("except_paths", _two(lambda a, b: a.select("path").subtract(b.select("path"))), "SELECT path FROM m1 EXCEPT SELECT path FROM m2")
_add("path_count", _one(lambda m: m.agg(F.count("*").alias("paths"))), "SELECT count(*) AS paths FROM m2")
_add("tree_size", _one(lambda m: m.agg(F.sum("size").alias("bytes"))), "SELECT CAST(sum(size) AS BIGINT) AS bytes FROM m2")

# --- predicates -----------------------------------------------------------------------------------

_RULES = [("exclude", "/src1/en/"), ("include", "/src1/**"), ("exclude", "*7.txt"), ("exclude", "/src2/*/*.lnk")]


def _dirs():
    return F.col("path_type") == "DIR"


_FIRST = """CASE WHEN regexp_matches(s, '^src1/en/$') THEN false WHEN regexp_matches(s, '^src1/.*/?$') THEN true WHEN regexp_matches(s, '^(?:.*/)?[^/]*7\\.txt/?$') THEN false WHEN regexp_matches(s, '^src2/[^/]*/[^/]*\\.lnk/?$') THEN false ELSE true END"""
_add("match_prefix", _one(lambda m: m.where(matchers.match_prefix(F.col("path"), ["src1", "src3/en"])).select("path")), "SELECT path FROM m2 WHERE path IN ('src1', 'src3/en') OR starts_with(path, 'src1/') OR starts_with(path, 'src3/en/')")
_add("match_set", _one(lambda m: m.where(matchers.match_set(F.col("path"), ["src1", "src2", "x"], False)).select("path")), "SELECT path FROM m2 WHERE path NOT IN ('src1', 'src2', 'x')")
_add("match_or", _one(lambda m: m.where(matchers.match_any(F.col("path") == ".", matchers.match_prefix(F.col("path"), ["moved"]))).select("path")), "SELECT path FROM m2 WHERE path = '.' OR path = 'moved' OR starts_with(path, 'moved/')")
_add("glob_match", _one(lambda m: m.where(F.col("path").rlike(scalars.glob_regex("/src*/**/*5.txt"))).select("path")), r"SELECT path FROM m2 WHERE regexp_matches(path, '^src[^/]*/.*/[^/]*5\.txt/?$')")
_add("filter_first_match", _one(lambda m: m.where(matchers.included(F.col("path"), _dirs(), _RULES)).select("path")), f", x AS (SELECT path, CASE WHEN path_type = 'DIR' THEN path || '/' ELSE path END AS s FROM m2) SELECT path FROM x WHERE {_FIRST}".replace("\\\\", "\\"))
_add("filter_pruned", _one(lambda m: m.where(matchers.included_with_parents(F.col("path"), _dirs(), _RULES)).select("path")), f", x AS (SELECT path, CASE WHEN path_type = 'DIR' THEN path || '/' ELSE path END AS s FROM m2) SELECT path FROM x WHERE {_FIRST} AND NOT starts_with(path, 'src1/en/')".replace("\\\\", "\\"))
_add("match_snapshots", lambda spark, sf: X.snapshots(spark).where(F.col("name").between("2020-01-02", "2020-01-03") & F.col("name").isin("2020-01-02-120000", "2020-01-03-120000")).select("name"), "SELECT name FROM snapshots WHERE name BETWEEN '2020-01-02' AND '2020-01-03' AND name IN ('2020-01-02-120000', '2020-01-03-120000')")

# --- scalars ---------------------------------------------------------------------------------------

_add("size_string", lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalars.size_string(F.pmod(F.col("o_orderkey") * 7919, F.lit(5000000))).alias("size")),
     "SELECT o_orderkey, regexp_replace(printf('%.1f', s / CASE WHEN s < 1024 THEN 1.0 WHEN s < 1048576 THEN 1024.0 ELSE 1048576.0 END), '\\.0$', '') || CASE WHEN s < 1024 THEN 'b' WHEN s < 1048576 THEN 'kb' ELSE 'mb' END AS size FROM (SELECT o_orderkey, (o_orderkey * 7919) % 5000000 AS s FROM orders)")
_add("size_parse", _one(lambda m: m.where("size is not null").select("path", scalars.size_bytes(F.concat(F.col("size").cast("string"), F.lit("kb"))).alias("bytes"))), "SELECT path, size * 1024 AS bytes FROM m2 WHERE size IS NOT NULL")
_add("path_parts", _one(lambda m: m.select("path", scalars.dirname(F.col("path")).alias("dir"), scalars.basename(F.col("path")).alias("base"))), "SELECT path, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir, string_split(path, '/')[-1] AS base FROM m2")
_add("mtime_string", _one(lambda m: m.select("path", F.date_format(F.timestamp_seconds("mtime"), "yyyy-MM-dd HH:mm:ss").alias("mtime"))), "SELECT path, strftime(make_timestamp(mtime * 1000000), '%Y-%m-%d %H:%M:%S') AS mtime FROM m2")
_add("snapshot_time", lambda spark, sf: X.snapshots(spark).select("name", F.unix_timestamp(F.to_timestamp("name", "yyyy-MM-dd-HHmmss")).alias("seconds")), "SELECT name, CAST(epoch(strptime(name, '%Y-%m-%d-%H%M%S')) AS BIGINT) AS seconds FROM snapshots")
_add("content_hash", lambda spark, sf: spark.read.parquet(f"{sf}/pages.parquet").select("page_id", F.sha2("html", 256).alias("sha256"), F.md5("html").alias("md5")), "SELECT page_id, sha256(html) AS sha256, md5(html) AS md5 FROM pages")
_add("dump_manifest", _one(lambda m: m.select("path", F.concat_ws(", ", F.concat(F.lower("path_type"), F.lit(" path="), "path"), F.concat(F.lit("mode="), "mode"), F.concat(F.lit("mtime="), "mtime"), F.concat(F.lit("size="), "size"), F.concat(F.lit("link-dest="), "link_dest"), F.concat(F.lit("sha256="), F.substring("sha256", 1, 6))).alias("line"))),
     "SELECT path, concat_ws(', ', lower(path_type) || ' path=' || path, 'mode=' || mode, 'mtime=' || mtime, 'size=' || size, 'link-dest=' || link_dest, 'sha256=' || substr(sha256, 1, 6)) AS line FROM m2")
_add("patch_mtime", _one(lambda m: planning.patch(m, "mtime", 1500000060, 1500000000).select("path", "mtime")), "SELECT path, CASE WHEN mtime = 1500000060 THEN 1500000000 ELSE mtime END AS mtime FROM m2")
_add("patch_mode", _one(lambda m: m.select("path", F.when(F.col("mode").bitwiseAND(4095) == 384, F.col("mode").bitwiseAND(61440).bitwiseOR(420)).otherwise(F.col("mode")).alias("mode"), scalars.octal(F.col("mode")).alias("was"))), "SELECT path, CASE WHEN (mode & 4095) = 384 THEN (mode & 61440) | 420 ELSE mode END AS mode, '0' || to_base(mode, 8) AS was FROM m2")
_add("escape_path", _one(lambda m: m.select("path", scalars.escape(F.col("path")).alias("escaped"))))

# --- duplicates and renames -------------------------------------------------------------------------

_add("dup_groups", _one(lambda m: duplicates.groups(m).where("n > 1")), f"SELECT sha256, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS first_path FROM m2 WHERE {_FILES} AND sha256 IS NOT NULL GROUP BY sha256 HAVING count(*) > 1")
_add("size_groups", _one(lambda m: duplicates.groups(m, "size").where("n > 1")), f"SELECT size, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes, min(path) AS first_path FROM m2 WHERE {_FILES} GROUP BY size HAVING count(*) > 1")
_add("rename_pairs", _two(lambda a, b: duplicates.pairs(b, a)), _pairs_sql("m2", "m1") + "SELECT path, candidate, same_content, duplicate, code FROM q")
_add("rename_flags", _two(lambda a, b: duplicates.counts(duplicates.pairs(b, a)).select("path", (F.col("duplicates") > 0).alias("renamed"))), _pairs_sql("m2", "m1") + "SELECT path, bool_or(duplicate) AS renamed FROM q GROUP BY path")
_add("dup_counts", _two(lambda a, b: duplicates.counts(duplicates.pairs(b, a))), _pairs_sql("m2", "m1") + 'SELECT path, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT duplicate) AS "similar" FROM q GROUP BY path')
_add("similar_rank", _two(lambda a, b: duplicates.ranked(duplicates.pairs(b, a)).select("path", "candidate", "ratio", "rank")))
_add("best_dup", _two(lambda a, b: duplicates.best(duplicates.pairs(b, a))))
_add("best_dup_by_path", _two(lambda a, b: duplicates.best(duplicates.pairs(b, a), by_path_only=True)), _pairs_sql("m2", "m1") + "SELECT path, min(candidate) AS best FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n FROM q) WHERE n < 10 AND duplicate GROUP BY path")
_add("dup_topk_by_path", _two(lambda a, b: duplicates.top(duplicates.pairs(b, a), by_path_only=True)), _pairs_sql("m2", "m1") + "SELECT path, candidate, duplicate, k FROM (SELECT *, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path, duplicate ORDER BY candidate) AS k FROM q) WHERE n < 10 AND k <= 5")
_add("dup_topk", _two(lambda a, b: duplicates.top(duplicates.pairs(b, a))))
_add("rename_by_size", _two(lambda a, b: duplicates.renames_by_size(a.join(b, "path", "left_anti"), b, 3)), f""",
s AS (SELECT size, count(*) AS bucket FROM m2 WHERE {_FILES} GROUP BY size), g AS (SELECT m1.path, m1.size, m1.sha256, coalesce(s.bucket, 0) AS bucket FROM m1 LEFT JOIN s ON s.size = m1.size WHERE m1.path_type = 'FILE' AND m1.size >= 1 AND path NOT IN (SELECT path FROM m2))
SELECT g.path, g.bucket, count(c.path) AS renames, min(c.path) AS first, g.bucket > 3 AS too_many FROM g LEFT JOIN m2 c ON c.size = g.size AND c.sha256 = g.sha256 AND c.path <> g.path AND c.path_type = 'FILE' AND g.bucket <= 3 GROUP BY g.path, g.bucket""")
_add("rename_cap", _two(lambda a, b: duplicates.renames_by_size(a.join(b, "path", "left_anti"), b)), f""",
s AS (SELECT size, count(*) AS bucket FROM m2 WHERE {_FILES} GROUP BY size), g AS (SELECT m1.path, m1.size, m1.sha256, coalesce(s.bucket, 0) AS bucket FROM m1 LEFT JOIN s ON s.size = m1.size WHERE m1.path_type = 'FILE' AND m1.size >= 1 AND path NOT IN (SELECT path FROM m2))
SELECT g.path, g.bucket, count(c.path) AS renames, min(c.path) AS first, g.bucket > 10 AS too_many FROM g LEFT JOIN m2 c ON c.size = g.size AND c.sha256 = g.sha256 AND c.path <> g.path AND c.path_type = 'FILE' AND g.bucket <= 10 GROUP BY g.path, g.bucket""")
_IN = "(path = 'src1' OR starts_with(path, 'src1/') OR path = 'moved' OR starts_with(path, 'moved/'))"
_inside = lambda p: matchers.match_prefix(p, ["src1", "moved"])
_DEL = "SELECT path, bool_or({same}) AS \"delete\", min(candidate) FILTER ({same}) AS duplicate_of, min(candidate) AS similar_to FROM q WHERE {a} AND NOT {b} GROUP BY path"
_add("delete_dups", _one(lambda m: duplicates.deletable(m, _inside)), _pairs_sql("m2", "m2") + _DEL.format(same="duplicate", a=_IN, b=_IN.replace("path", "candidate")))
_add("delete_dups_ignoring", _one(lambda m: duplicates.deletable(m, _inside, ignore=("time_diff", "permission_diff", "xattr_diff"))), _pairs_sql("m2", "m2") + _DEL.format(same="NOT (checksum_diff OR replace_path OR size_diff)", a=_IN, b=_IN.replace("path", "candidate")))
_add("delete_dups_cross", _two(lambda a, b: duplicates.deletable(b, _inside, a, allow_inside=True)), _pairs_sql("m2", "m1") + _DEL.format(same="duplicate", a=_IN, b="false"))

# --- plans ---------------------------------------------------------------------------------------------

_SYNC = _J + f""", t AS (SELECT sha256, min(path) AS "to" FROM m2 WHERE {_FILES} GROUP BY sha256),
p AS (SELECT j.path, CASE WHEN new_path THEN 'add' WHEN delete_path THEN CASE WHEN t."to" IS NOT NULL THEN 'renamed' ELSE 'delete' END ELSE 'update' END AS action, code, t."to" AS renamed_to, CASE WHEN in_new THEN coalesce(n_size, 0) ELSE 0 END AS bytes
  FROM j LEFT JOIN t ON delete_path AND j.o_sha = t.sha256 AND coalesce(o_size, 0) >= 1 WHERE changed)
"""
_add("sync_plan", _two(planning.sync_plan), _SYNC + "SELECT path, action, code, renamed_to, bytes FROM p")
_add("sync_stats", _two(planning.sync_stats), _SYNC + "SELECT count(*) AS synced, CAST(sum(bytes) AS BIGINT) AS synced_bytes, count(*) FILTER (action = 'renamed') AS renamed, count(*) FILTER (action = 'delete') AS deleted FROM p")
_add("checkpoint_delta", _two(lambda a, b: planning.checkpoint_delta(a, b, checksum_all=True).select("path", "size", "sha256")), _J + "SELECT path, n_size AS size, n_sha AS sha256 FROM j WHERE in_new AND (changed OR (in_old AND n_sha IS DISTINCT FROM o_sha))")
_add("checkpoint_stats", _two(lambda a, b: planning.checkpoint_delta(a, b).agg(F.count("*").alias("changed"), F.coalesce(F.sum("size"), F.lit(0)).alias("changed_bytes"))), _J + "SELECT count(*) AS changed, CAST(coalesce(sum(n_size), 0) AS BIGINT) AS changed_bytes FROM j WHERE in_new AND changed")
_add("apply_plan", _two(lambda a, b: planning.apply_plan(a, b, planning.checkpoint_delta(a, b).where("mode != 33152"))), _J + """, p AS (SELECT j.*, in_new AND j.path_type = 'FILE' AND (new_path OR checksum_diff OR size_diff) AS needs, m2.mode <> 33152 AS held FROM j LEFT JOIN m2 ON m2.path = j.path WHERE changed)
SELECT path, CASE WHEN delete_path THEN 'delete' WHEN needs AND NOT held THEN 'error' WHEN new_path THEN 'create' ELSE 'change' END AS action, code FROM p""")
_add("copy_plan", _two(lambda a, b: planning.copy_plan(b, a)), _J + _pairs_sql("m2", "m1").replace(",\nq0", ",\nq0", 1) + """, d AS (SELECT path, min(candidate) AS other FROM q WHERE duplicate GROUP BY path)
SELECT j.path, CASE WHEN in_old AND NOT changed THEN CASE WHEN path_type = 'FILE' THEN 'link' ELSE 'copy-from-last' END WHEN path_type = 'FILE' AND other IS NOT NULL THEN 'link-to-duplicate' ELSE 'copy' END AS action,
  CASE WHEN in_old AND NOT changed AND path_type = 'FILE' THEN j.path WHEN path_type = 'FILE' AND NOT (in_old AND NOT changed) THEN other END AS link_to FROM j LEFT JOIN d ON d.path = j.path WHERE in_new""")
_add("reroot", _one(lambda m: planning.reroot(m, "src1").select("path", "path_type")), "SELECT CASE WHEN path = 'src1' THEN '.' ELSE substr(path, 6) END AS path, path_type FROM m2 WHERE path = 'src1' OR starts_with(path, 'src1/')")
_add("rebase_paths", _one(lambda m: planning.rebase(m, "src1", "new/place").select("path")), "SELECT 'new/place' || substr(path, 5) AS path FROM m2 WHERE path = 'src1' OR starts_with(path, 'src1/')")
_add("rename_paths", _one(lambda m: planning.rename_paths(m, "^src1/", "src2/")), "SELECT path, regexp_replace(path, '^src1/', 'src2/') AS new_path FROM m2")
_add("rename_collisions", _one(lambda m: planning.rename_collisions(planning.rename_paths(m, "^src(1|11)/", "src2/"))), """, r AS (SELECT path, regexp_replace(path, '^src(1|11)/', 'src2/') AS new_path FROM m2)
SELECT DISTINCT a.path, a.new_path FROM r a WHERE a.path <> a.new_path AND (
  EXISTS (SELECT 1 FROM r b WHERE b.path = a.new_path AND NOT (b.path <> b.new_path AND b.path < a.path)) OR EXISTS (SELECT 1 FROM r b WHERE b.new_path = a.new_path AND b.path <> b.new_path AND b.path < a.path))""")
_add("ancestor_closure", _two(lambda a, b: planning.ancestor_closure(b.where("path_type = 'FILE'"), a)), """, x AS (SELECT string_split(path, '/') AS p FROM m2 WHERE path_type = 'FILE'), y AS (SELECT DISTINCT array_to_string(p[1 : k], '/') AS path FROM (SELECT p, unnest(range(1, len(p) + 1)) AS k FROM x) UNION SELECT '.')
SELECT path FROM y WHERE path NOT IN (SELECT path FROM m1)""")
_add("restore_mtimes", _two(lambda a, b: planning.restore_mtimes(b, a)), "SELECT m2.path, m2.mtime AS old, m1.mtime FROM m2 JOIN m1 ON m1.path = m2.path WHERE m1.mtime <> m2.mtime")
_add("manifest_duplicate_keys", _one(diff.check_unique), "SELECT path, count(*) AS n FROM m2 GROUP BY path HAVING count(*) > 1")
_add("inode_reuse", _one(lambda m: planning.reuse_hashes(m.select("path", F.lit(1).alias("dev"), F.xxhash64("sha256").alias("ino"), F.lit(None).cast("string").alias("sha256")).where("path_type = 'FILE'"), m.where("sha256 is not null").select(F.lit(1).alias("dev"), F.xxhash64("sha256").alias("ino"), "sha256")).select("path", "sha256", "hit")), "SELECT path, sha256, sha256 IS NOT NULL AS hit FROM m2 WHERE path_type = 'FILE'")

# --- changes with renames ------------------------------------------------------------------------------

_EQUAL = " AND ".join(f"c.{x} IS NOT DISTINCT FROM s.{x}" for x in ("mode", "mtime", "size", "link_dest", "xattr_hash"))


def _renames_sql(new: str, gone: str, order: str) -> str:
    """Changed rows with the numbers of files of equal content in m1 (for ``new``) or m2 (for ``gone``)."""
    asked = {"n": f"({new}) AND s.path_type = 'FILE' AND s.size >= 1", "o": f"({gone}) AND s.path_type = 'FILE' AND s.size >= 1"}
    found = " UNION ALL ".join(
        f"""SELECT j.path, '{verb}' AS verb, count(c.path) FILTER ({_EQUAL}) AS duplicates, count(c.path) FILTER (NOT ({_EQUAL})) AS "similar"
  FROM j JOIN {own} s ON s.path = j.path LEFT JOIN {other} c ON c.sha256 = s.sha256 AND c.path_type = 'FILE' AND c.size >= 1 WHERE changed AND {asked[side]} GROUP BY j.path"""
        for side, own, other, verb in (("n", "m2", "m1", "replacing"), ("o", "m1", "m2", "replaced by"))
    )
    return _J + f""", f0 AS ({found}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY verb {order}) AS k FROM f0) WHERE k = 1),
rn AS (SELECT j.path, j.code, f.verb, coalesce(f.duplicates, 0) AS duplicates, coalesce(f."similar", 0) AS "similar", j.severity FROM j LEFT JOIN f ON f.path = j.path WHERE changed)
SELECT path, code, verb, duplicates, "similar", duplicates > 0 AS renamed, duplicates + "similar" < 10 AS ranked, CASE WHEN duplicates > 0 THEN 'purple' ELSE severity END AS severity FROM rn"""


_add("diff_with_renames", _two(lambda a, b: renames.diff_with_renames(b, a)), _renames_sql("in_new", "delete_path", "DESC"))
_add("diff_ignore_renames", _two(lambda a, b: renames.diff_with_renames(b, a, ignore_renames=True)), _renames_sql("in_new", "delete_path", "DESC") + " WHERE duplicates = 0")
_add("checkpoint_renames", _two(renames.checkpoint_renames), _renames_sql("new_path", "delete_path OR checksum_diff", "DESC"))
_add("sync_new_renames", _two(renames.new_renames), _renames_sql("new_path", "false", "DESC") + " WHERE verb IS NOT NULL")
_add("dup_counts_large", _two(lambda a, b: renames.large_counts(b, a)), _pairs_sql("m2", "m1") + 'SELECT * FROM (SELECT path, count(*) FILTER (duplicate) AS duplicates, count(*) FILTER (NOT duplicate) AS "similar" FROM q GROUP BY path) WHERE duplicates + "similar" >= 10')
_add("strip_bidi", _one(lambda m: m.select("path", scalars.strip_bidi(F.concat(F.lit("\u2068"), "path", F.lit("\u2069"))).alias("plain"))), "SELECT path, path AS plain FROM m2")
_add("octal_escapes", _one(lambda m: m.select("path", scalars.decode_octal_escapes(F.concat(F.replace("path", F.lit("/"), F.lit("\\#057")), F.lit("\\#012\\x"))).alias("decoded"))), r"SELECT path, path || chr(10) || '\x' AS decoded FROM m2")
_LINKED = ["link", "link-to-duplicate"]
_add("checksum_scope", _two(lambda a, b: planning.copy_plan(b, a).where("link_to is null").select("path")), f", z AS ({ORACLE_SQL['copy_plan']}) SELECT path FROM z WHERE link_to IS NULL")
_add("copy_stats", _two(lambda a, b: planning.copy_plan(b, a).agg(F.count("*").alias("copied"), F.count_if(F.col("action").isin(_LINKED)).alias("hard_linked"), F.count_if(F.col("action") == _LINKED[1]).alias("linked_elsewhere"))),
     f", z AS ({ORACLE_SQL['copy_plan']}) SELECT count(*) AS copied, count(*) FILTER (action IN ('link', 'link-to-duplicate')) AS hard_linked, count(*) FILTER (action = 'link-to-duplicate') AS linked_elsewhere FROM z")

# --- series ------------------------------------------------------------------------------------------------

_NEAR = """,
near AS (SELECT name, state, pruneable, last_value(CASE WHEN state = 'DONE' THEN name END IGNORE NULLS) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev,
  first_value(CASE WHEN state = 'DONE' THEN name END IGNORE NULLS) OVER (ORDER BY name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next, lead(name) OVER (ORDER BY name) AS superseding FROM snapshots)
"""


def _series(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: f(X.series(spark, sf), X.snapshots(spark))


def _unique_sql(prev: bool, nxt: bool) -> str:
    sql, at = _NEAR, "series"
    for k, (side, used) in enumerate((("prev", prev), ("next", nxt))):
        if used:
            sql += f""", u{k} AS (SELECT * FROM (SELECT n.*, {_flags_sql()} FROM {at} n JOIN near ON near.name = n.snapshot LEFT JOIN series o ON o.snapshot = near.{side} AND o.path = n.path) WHERE {_HAS}), v{k} AS (SELECT {_COLUMNS} FROM u{k})
"""
            at = f"v{k}"
    return sql + f"SELECT snapshot, path, path_type, coalesce(size, 0) AS size FROM {at}"


_COLUMNS = "snapshot, path, path_type, mode, mtime, size, uid, gid, link_dest, sha256, xattr_hash"
_add("prev_next_snapshot", lambda spark, sf: series.neighbours(X.snapshots(spark)), _NEAR + "SELECT * FROM near")
_add("latest_snapshot", lambda spark, sf: series.latest(X.snapshots(spark)), "SELECT max(name) AS latest FROM snapshots WHERE state = 'DONE'")
_add("superseding_snapshot", lambda spark, sf: series.neighbours(X.snapshots(spark)).select("name", "superseding"), _NEAR + "SELECT name, superseding FROM near")
_add("list_snapshots", lambda spark, sf: X.snapshots(spark).select("name", "pruneable"), "SELECT name, pruneable FROM snapshots")
_add("prune_window", lambda spark, sf: series.prune_window(X.snapshots(spark)), "SELECT name FROM snapshots WHERE state = 'DONE' AND name > (SELECT coalesce(max(name), '') FROM snapshots WHERE state = 'DONE' AND NOT pruneable)")
_add("skipped_runs", lambda spark, sf: series.skipped_runs(X.snapshots(spark), "2020-01-02-120000", "2020-01-02-120000"), "SELECT count(*) AS n, min(name) AS first, max(name) AS last FROM snapshots WHERE name <> '2020-01-02-120000' GROUP BY name > '2020-01-02-120000'")
_add("merge_series_plan", lambda spark, sf: series.merge_plan(X.snapshots(spark).where("name < '2020-01-03'"), X.snapshots(spark).where("name > '2020-01-02'")), "SELECT name, CASE WHEN name < '2020-01-02' THEN 'retain' WHEN name < '2020-01-03' THEN 'merge' ELSE 'import' END AS action FROM snapshots")
_add("merge_conflicts", lambda spark, sf: series.merge_conflicts(X.manifest(spark, sf, "m2").withColumn("snapshot", F.lit("a")), X.manifest(spark, sf, "m1").withColumn("snapshot", F.lit("a"))), _J + "SELECT 'a' AS snapshot, path, code FROM j WHERE in_new AND in_old AND changed")
_add("unique_in_snapshot", _series(series.unique), _unique_sql(True, True))
_add("unique_prev_only", _series(lambda s, n: series.unique(s, n, use_next=False)), _unique_sql(True, False))
_add("unique_next_only", _series(lambda s, n: series.unique(s, n, use_prev=False)), _unique_sql(False, True))
_add("unique_stats", _series(series.unique_stats), f"SELECT s.snapshot, s.total, coalesce(u.n, 0) AS unique_paths, CAST(coalesce(u.b, 0) AS BIGINT) AS unique_bytes FROM (SELECT snapshot, count(*) AS total FROM series GROUP BY snapshot) s LEFT JOIN (SELECT snapshot, count(*) AS n, sum(size) AS b FROM (WITH {X.DUCK}{_unique_sql(True, True)}) GROUP BY snapshot) u ON u.snapshot = s.snapshot")
_add("extract_paths", _series(lambda s, n: s.where(matchers.match_prefix(F.col("path"), ["src1", "moved/src2"])).select("snapshot", "path")), "SELECT snapshot, path FROM series WHERE path IN ('src1', 'moved/src2') OR starts_with(path, 'src1/') OR starts_with(path, 'moved/src2/')")
_add("delete_in_series", _series(lambda s, n: s.where(~matchers.match_prefix(F.col("path"), ["src1"])).groupBy("snapshot").agg(F.count("*").alias("paths"))), "SELECT snapshot, count(*) AS paths FROM series WHERE NOT (path = 'src1' OR starts_with(path, 'src1/')) GROUP BY snapshot")
_add("verify_fast_stats", _series(lambda s, n: series.with_previous(s, n).groupBy(F.col("name").alias("snapshot")).agg(F.count_if(itemize.has_diffs()).alias("unique_rows"), F.count_if(~itemize.has_diffs()).alias("matching"))), _NEAR + f"SELECT snapshot, count(*) FILTER {_HAS.join(('(', ')'))} AS unique_rows, count(*) FILTER (NOT {_HAS}) AS matching FROM (SELECT n.snapshot, {_flags_sql()} FROM series n JOIN near ON near.name = n.snapshot LEFT JOIN series o ON o.snapshot = near.prev AND o.path = n.path) GROUP BY snapshot")


def _dedup_sql(older: bool) -> str:
    has = _HAS.replace("time_diff", "(time_diff AND NOT older)") if older else _HAS
    return _NEAR + f""", q AS (SELECT n.snapshot, n.path, o.path AS candidate, n.size, o.mtime < n.mtime AS older, {_flags_sql('n', 'o', 'true', 'true')} FROM series n JOIN near ON near.name = n.snapshot AND near.state = 'DONE' JOIN series o ON o.snapshot = near.prev AND o.sha256 = n.sha256
  WHERE n.path_type = 'FILE' AND n.size >= 100 AND o.path_type = 'FILE' AND o.size >= 100), p AS (SELECT *, NOT {has} AS same FROM q),
r AS (SELECT snapshot, path, min(candidate) FILTER (same) AS link_to, bool_or(same) AS duplicate, min(size) AS size FROM p GROUP BY snapshot, path)
"""


_add("dedup_plan", _series(lambda s, n: series.dedup_plan(s, n, least=100)), _dedup_sql(False) + "SELECT * FROM r")
_add("dedup_older_mtime", _series(lambda s, n: series.dedup_plan(s, n, least=100, older_mtimes=True)), _dedup_sql(True) + "SELECT * FROM r")
_add("dedup_stats", _series(lambda s, n: series.dedup_stats(s, n, least=100)), _dedup_sql(False) + 'SELECT snapshot, count(*) FILTER (duplicate) AS duplicates, CAST(coalesce(sum(size) FILTER (duplicate), 0) AS BIGINT) AS duplicate_bytes, count(*) FILTER (NOT duplicate) AS "similar" FROM r GROUP BY snapshot')


_STORED = "path, path_type, mode, mtime, size, uid, gid, link_dest, sha256, xattr_hash"
_add("manifest_roundtrip", _one(lambda m: messages.from_messages(messages.to_messages(m)).select(*_STORED.split(", "))), f"SELECT {_STORED} FROM m2")

_RULE_FILES = [(".", "# at the root\nexclude *1.txt\ninclude *.lnk"), ("src1", "exclude *2.txt\ninclude *1.txt"), ("src1/en", "exclude *.lnk\ninclude *2.txt"), ("src2", "exclude /de/")]
_add(
    "filter_dir_merge",
    _one(lambda m: merge_rules.filter_dir_merge(m, m.sparkSession.createDataFrame(_RULE_FILES, "dir string, text string"), before=[("exclude", "*77.txt")]).select("path")),
    """SELECT path FROM m2 WHERE CASE WHEN path LIKE '%77.txt' THEN false
  WHEN starts_with(path, 'src1/en/') AND path LIKE '%.lnk' THEN false WHEN starts_with(path, 'src1/en/') AND path LIKE '%2.txt' THEN true
  WHEN starts_with(path, 'src1/') AND path LIKE '%2.txt' THEN false WHEN starts_with(path, 'src1/') AND path LIKE '%1.txt' THEN true
  WHEN path = 'src2/de' AND path_type = 'DIR' THEN false WHEN path LIKE '%1.txt' THEN false ELSE true END
  AND NOT (starts_with(path, 'src2/de/') AND EXISTS (SELECT 1 FROM m2 WHERE path = 'src2/de' AND path_type = 'DIR'))""",
)


def _legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    files = docs.select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), "md5", F.col("doc_id").alias("inode"))
    short = F.when(F.col("doc_id") % 5 == 0, F.lit("abc")).otherwise(F.regexp_replace("md5", "^0+", ""))
    sums = docs.where("doc_id % 7 <> 3").select(F.concat(F.when(F.col("doc_id") % 50 == 0, "gone").otherwise("f"), F.col("doc_id").cast("string")).alias("path"), short.alias("checksum"))
    return legacy.verify_md5(files, sums, ignore="f.*8$", seen=docs.where("doc_id % 11 = 0").select(F.col("doc_id").alias("inode")))


_add(
    "legacy_verify",
    _legacy,
    """SELECT concat('f', CAST(doc_id AS VARCHAR)) AS path, CASE WHEN doc_id % 11 = 0 THEN 'hit' WHEN doc_id % 7 = 3 OR doc_id % 50 = 0 THEN CASE WHEN doc_id % 10 = 8 THEN 'ignored' ELSE 'missing' END
  WHEN doc_id % 5 = 0 THEN 'mismatch' ELSE 'ok' END AS outcome FROM documents
  UNION ALL SELECT concat('gone', CAST(doc_id AS VARCHAR)), 'unverified' FROM documents WHERE doc_id % 50 = 0 AND doc_id % 7 <> 3""",
)

_NAMES = """SELECT concat('backups/2020-01-', lpad(CAST(doc_id % 28 + 1 AS {text}), 2, '0'), '-', lpad(CAST(doc_id % 1000000 AS {text}), 6, '0'), CASE WHEN doc_id % 3 = 0 THEN '-manifest' ELSE '' END,
  CASE doc_id % 5 WHEN 0 THEN '.img' WHEN 1 THEN '.luks.img' WHEN 2 THEN '.sparseimage' WHEN 3 THEN '.img.bak' ELSE '' END) AS path FROM {docs}"""
_BASE = r"regexp_extract(path, '/([0-9]{4}-[0-9]{2}-[0-9]{2}-[0-9]{6})(-manifest)?[.](sparseimage|img|luks.img)$', %d)"
_IMAGES = f", names AS ({_NAMES.format(text='VARCHAR', docs='documents')}), images AS (SELECT path, {_BASE % 1} AS name, {_BASE % 2} <> '' AS manifest_only, {_BASE % 3} AS suffix FROM names WHERE {_BASE % 1} <> '') "


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_NAMES.format(text="STRING", docs="{docs}"), docs=spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"))


_add("parse_checkpoint_name", lambda spark, sf: _names(spark, sf).select("path", *(c.alias(k) for k, c in legacy.parse_image_name(F.col("path")).items())), _IMAGES + "SELECT n.path, i.name, i.manifest_only, i.suffix FROM names n LEFT JOIN images i ON i.path = n.path")
_add("list_checkpoints", lambda spark, sf: legacy.list_images(_names(spark, sf)), _IMAGES + "SELECT * FROM images")
_add("checkpoints_to_apply", lambda spark, sf: legacy.images_to_apply(legacy.list_images(_names(spark, sf)).where("NOT manifest_only"), X.snapshots(spark)), _IMAGES + "SELECT * FROM images WHERE NOT manifest_only AND name > (SELECT max(name) FROM snapshots WHERE state = 'DONE')")
