"""Reading repositories from storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.paths import normalize_path
from factloom.operators.files import is_excluded_path


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """Catalog of all files below ``root``, one directory per repository: (repo_id, path, size_bytes, is_symlink, content).

    ``content`` stays binary and is only read when it is selected.  Excluded directories are dropped by path.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = normalize_path(F.lit(root.rstrip("/\\")))
    # the scheme is not part of the caller's root
    full = F.regexp_replace(normalize_path(F.col("path")), r"^[a-z0-9]+:/*(?=/)", "")
    plain = F.regexp_replace(base, r"^[a-z0-9]+:/*(?=/)", "")
    below = F.substring(full, F.length(plain) + 2, F.length(full))
    rel = raw.select(
        F.substring_index(below, "/", 1).alias("repo_id"),
        F.substring(below, F.instr(below, "/") + 1, F.length(below)).alias("path"),
        F.col("length").alias("size_bytes"), F.lit(False).alias("is_symlink"), "content",
    )
    return rel.filter(~is_excluded_path(F.col("path")))


def read_text(files: DataFrame) -> DataFrame:
    """Binary ``content`` to UTF-8 text; files with more than 1 % NUL bytes in the first 8000 have none and are flagged."""
    head = F.decode(F.substring("content", 1, 8000), "ISO-8859-1")
    nul = F.length(head) - F.length(F.replace(head, F.lit("\0"), F.lit("")))
    binary = nul > F.lit(0.01) * F.length(head)
    # invalid sequences become replacement characters instead of failing the file
    text = F.make_valid_utf8(F.col("content").cast("string"))
    flagged = files.withColumn("is_binary", binary)
    return flagged.withColumn("content", F.when(~F.col("is_binary"), text))
