"""Path expressions (POSIX, forward slashes)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Directory of a relative path, '.' at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def extname(name: Column) -> Column:
    """Last extension with its dot; a leading dot does not start one ('.env' has none)."""
    dotted = F.instr(F.substring(name, 2, 1 << 20), ".") > 0
    return F.when(dotted, F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def resolve_relative(from_path: Column, raw: Column) -> Column:
    """Join ``raw`` to the directory of ``from_path`` and collapse '.' and '..'.  Most references need no more than their './' removed,
    which is tested and done without taking the path apart."""
    joined = F.concat_ws("/", dirname(from_path), raw)
    walled = F.replace(F.concat(F.lit("/"), joined, F.lit("/")), F.lit("/./"), F.lit("/"))
    plain = ~walled.contains("//") & ~walled.contains("/./") & ~walled.contains("/../") & (walled != "/")
    pieces = F.filter(F.split(joined, "/", -1), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(
        pieces,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != ".."),
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.array_append(acc, p)),
    )
    folded = F.when(F.size(stack) == 0, F.lit(".")).otherwise(F.array_join(stack, "/"))
    return F.when(plain, F.substring(walled, F.lit(2), F.length(walled) - 2)).otherwise(folded)


def repo_name_from_remote(remote: Column) -> Column:
    """Last segment of a git remote, without '.git'."""
    return F.trim(F.regexp_extract(F.regexp_replace(remote, r"\.git\z", ""), r"([^/\\:]*)\z", 1))
