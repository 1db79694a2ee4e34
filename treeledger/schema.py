"""The row of a manifest: one path of a snapshot of a file tree."""

from pyspark.sql import types as T

DIR, FILE, SYMLINK = "DIR", "FILE", "SYMLINK"
IFMT, IMODE = 61440, 4095

MANIFEST = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("path_type", T.StringType()),
        T.StructField("mode", T.LongType()),
        T.StructField("mtime", T.LongType()),
        T.StructField("size", T.LongType()),
        T.StructField("uid", T.LongType()),
        T.StructField("gid", T.LongType()),
        T.StructField("link_dest", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("xattr_hash", T.StringType()),
        T.StructField("xattr_keys", T.ArrayType(T.StringType())),
        T.StructField("google_drive_remote_file", T.BooleanType()),
    ]
)
COLUMNS = MANIFEST.fieldNames()
FLAGS = ["new_path", "replace_path", "delete_path", "checksum_diff", "size_diff", "time_diff", "permission_diff", "uid_diff", "gid_diff", "xattr_diff"]
