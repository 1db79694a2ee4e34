"""Itemized changes of a path: flags, the nine-character code, severity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import IFMT, IMODE


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def flags(new: str, old: str, new_side: Column, old_side: Column) -> dict[str, Column]:
    """Flags of the change from ``old.*`` to ``new.*``; the side columns tell whether each exists.

    A hash that either side doesn't know is compatible with any. Owner and group are shown but do not
    count as differences unless asked for.
    """
    n, o = (lambda c: F.col(f"{new}.{c}")), (lambda c: F.col(f"{old}.{c}"))
    both = new_side & old_side
    kind = n("mode").bitwiseAND(IFMT) != o("mode").bitwiseAND(IFMT)
    content = n("sha256").isNotNull() & o("sha256").isNotNull() & (n("sha256") != o("sha256"))
    xattr = _differs(n("xattr_hash"), o("xattr_hash")) | _differs(n("xattr_keys"), o("xattr_keys")) | _differs(n("google_drive_remote_file"), o("google_drive_remote_file"))
    at = lambda c: F.coalesce(both & c, F.lit(False))
    return {
        "new_path": new_side & ~old_side,
        "replace_path": at(kind | content),
        "delete_path": old_side & ~new_side,
        "checksum_diff": at(kind | content | _differs(n("link_dest"), o("link_dest"))),
        "size_diff": at(_differs(n("size"), o("size"))),
        "time_diff": at(_differs(n("mtime"), o("mtime"))),
        "permission_diff": at(n("mode").bitwiseAND(IMODE) != o("mode").bitwiseAND(IMODE)),
        "uid_diff": at(_differs(n("uid"), o("uid"))),
        "gid_diff": at(_differs(n("gid"), o("gid"))),
        "xattr_diff": at(xattr),
    }


def has_diffs(ignore_uid: bool = True, ignore_gid: bool = True) -> Column:
    names = ["new_path", "replace_path", "delete_path", "checksum_diff", "size_diff", "time_diff", "permission_diff", "xattr_diff"]
    names += ["uid_diff"] * (not ignore_uid) + ["gid_diff"] * (not ignore_gid)
    out = F.col(names[0])
    for n in names[1:]:
        out = out | F.col(n)
    return out


def code(kind: str = "path_type") -> Column:
    """``*f.delete``, ``>f+++++++`` or change mark, type letter and one letter per kind of change."""
    letter = F.when(F.col(kind) == "DIR", "d").when(F.col(kind) == "SYMLINK", "L").otherwise("f")
    marks = [("checksum_diff", "c"), ("size_diff", "s"), ("time_diff", "t"), ("permission_diff", "p"), ("uid_diff", "o"), ("gid_diff", "g"), ("xattr_diff", "x")]
    changes = F.concat(*[F.when(F.col(c), x).otherwise(".") for c, x in marks])
    head = F.when(F.col("new_path") | F.col("replace_path"), ">").otherwise(".")
    return F.when(F.col("delete_path"), F.concat(F.lit("*"), letter, F.lit(".delete"))).otherwise(F.concat(head, letter, F.when(F.col("new_path"), "+++++++").otherwise(changes)))


def severity() -> Column:
    return F.when(F.col("delete_path") | F.col("checksum_diff") | F.col("size_diff"), "red").when(F.col("new_path"), "green").when(F.col("time_diff") | F.col("permission_diff"), "yellow").when(F.col("xattr_diff"), "purple").otherwise("none")
