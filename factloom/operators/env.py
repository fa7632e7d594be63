"""Environment variables: definitions in dotenv files, references in source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.paths import basename, extname
from factloom.functions.ranking import first_per_key
from factloom.functions.regex import extract_groups, to_java, trim_ws

DEFINITION = to_java(r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=(.*)$")


def purpose_of(name: Column) -> Column:
    return F.coalesce(*[F.when(name.rlike(to_java(rx, "i")), F.lit(p)) for rx, p in signals.ENV_PURPOSES])


def is_secret(name: Column) -> Column:
    return name.rlike("(?i)" + "|".join(signals.ENV_SECRET_WORDS))


def is_env_file(path: Column) -> Column:
    name = basename(path)
    return name.startswith(".env") | name.endswith(".env")


def _not_symlink(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_symlink")) if "is_symlink" in files.columns else files


def env_file_keys(cat: DataFrame) -> DataFrame:
    """Keys of files classified as dotenv files, and whether any line has a real value."""
    env = cat.filter(F.col("extraction_type") == "env")
    lines = F.split("content", "\n", -1)
    trimmed = F.transform(lines, trim_ws)
    declared = F.filter(trimmed, lambda l: (l != "") & ~l.startswith("#") & l.contains("="))
    keys = F.filter(F.transform(declared, lambda l: trim_ws(F.substring_index(l, "=", 1))), lambda k: k != "")

    def real(line: Column) -> Column:
        value = trim_ws(F.substring(line, F.instr(line, "=") + 1, F.length(line)))
        return line.contains("=") & (value != "") & ~value.isin('""', "''") & ~value.startswith("#")

    return env.select("repo_id", "path", keys.alias("keys"), F.exists(lines, real).alias("has_real_values"))


def env_definitions(files: DataFrame) -> DataFrame:
    """``KEY=value`` lines of dotenv files."""
    env = _not_symlink(files).filter(is_env_file(F.col("path")))
    lines = env.select("repo_id", "path", F.posexplode(F.split("content", "\n", -1)).alias("i", "line"))
    trimmed = lines.withColumn("line", trim_ws(F.col("line"))).filter(
        ~F.col("line").startswith("#") & F.col("line").rlike(DEFINITION)
    )
    name = F.regexp_extract("line", DEFINITION, 1)
    return trimmed.select(
        "repo_id", name.alias("name"), "path", (F.col("i") + 1).alias("line_no"),
        (trim_ws(F.regexp_extract("line", DEFINITION, 2)) != "").alias("has_value"),
        F.col("path").rlike(r"\.(?:example|template|sample|dist)\z").alias("is_template"),
        purpose_of(name).alias("purpose"), is_secret(name).alias("is_secret"),
    )


def env_references(files: DataFrame) -> DataFrame:
    """Names that source files read from the environment, in pattern order then text order."""
    path = F.col("path")
    src = _not_symlink(files).filter(
        extname(basename(path)).isin(*signals.ENV_SOURCE_EXTENSIONS)
        & ~path.contains("node_modules") & ~path.contains(".test.") & ~path.contains(".spec.")
    )
    names = F.flatten(F.array(*[extract_groups(F.col("content"), to_java(rx)) for rx in signals.ENV_REFERENCE_REGEXES]))
    found = src.select("repo_id", "path", F.posexplode(names).alias("i", "name"))
    return found.select(
        "repo_id", "name", "path", (F.col("i") + 1).alias("ref_no"),
        purpose_of(F.col("name")).alias("purpose"), is_secret(F.col("name")).alias("is_secret"),
    )


def env_inventory(files: DataFrame) -> DataFrame:
    """First mention per name: dotenv files before source files, then path, then position."""
    defs = env_definitions(files).withColumn("rank", F.lit(0)).withColumnRenamed("line_no", "pos")
    refs = env_references(files).select(
        "repo_id", "name", "path", F.col("ref_no").alias("pos"), F.lit(False).alias("has_value"),
        F.lit(False).alias("is_template"), "purpose", "is_secret", F.lit(1).alias("rank"),
    )
    return first_per_key(defs.unionByName(refs), ["repo_id", "name"], [F.col("rank"), F.col("path"), F.col("pos")])


def env_undeclared(files: DataFrame) -> DataFrame:
    """Names read in source but defined in no dotenv file of the repository."""
    used = env_references(files).select("repo_id", "name").distinct()
    return used.join(env_definitions(files).select("repo_id", "name"), ["repo_id", "name"], "left_anti")


def required_and_optional(inventory: DataFrame) -> DataFrame:
    """Secrets that are not only in a template are required, the rest optional."""
    need = F.when(F.col("is_secret") & ~F.col("is_template"), F.lit("required")).otherwise(F.lit("optional"))
    return inventory.select("repo_id", "name", need.alias("need"), F.coalesce("purpose", F.lit("unknown")).alias("purpose"))


def env_listing(inventory: DataFrame) -> DataFrame:
    """Secret / plain variables per repository with the text of the listing."""
    label = F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" — "), F.col("purpose")), F.lit("")))
    return inventory.select("repo_id", "is_secret", "name", label.alias("label"))
