"""Catalog and classification of files.

A files table has ``repo_id, path, content`` and optionally ``size_bytes`` and ``is_symlink``.  Everything here
is a projection or a combinable aggregate; classification reads ``path`` only, so a scan that asks for nothing
else does not touch ``content``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.paths import basename, dirname, extname, normalize_path, parts
from factloom.functions.regex import to_java


def lookup(mapping: dict[str, str], key: Column) -> Column:
    """Value of a fixed dictionary, NULL when absent.  Compiled comparisons, grouped by value; a map literal would be
    searched entry by entry."""
    keys_of: dict[str, list[str]] = {}
    for k, value in mapping.items():
        keys_of.setdefault(value, []).append(k)
    return F.coalesce(*[F.when(key.isin(*keys), F.lit(value)) for value, keys in keys_of.items()])


def any_of(col: Column, fragments: Sequence[str], how: str = "contains") -> Column:
    out = F.lit(False)
    for fragment in fragments:
        out = out | getattr(col, how)(fragment)
    return out


# ---------------------------------------------------------------- predicates on paths


_EXCLUDED = r"(?:^|/)(?:%s|\.(?!(?:%s)/)[^/]*)/" % (
    "|".join(d.replace(".", r"\.") for d in signals.EXCLUDED_DIRS),
    "|".join(d[1:] for d in signals.KEPT_DOT_DIRS),
)


def in_directory(path: Column, names: Sequence[str], or_name: bool = False) -> Column:
    """A directory of the path (or, with ``or_name``, its last part too) is one of ``names``."""
    listed = "|".join(n.replace(".", r"\.") for n in names)
    return path.rlike(rf"(?:^|/)(?:{listed})" + (r"(?:/|\z)" if or_name else "/"))


def is_excluded_path(path: Column) -> Column:
    """Below an excluded directory, or a dot directory that is not kept.  Dot files stay."""
    return path.rlike(_EXCLUDED)


def drop_excluded_paths(files: DataFrame) -> DataFrame:
    return files.filter(~is_excluded_path(F.col("path")))


def language_of(path: Column) -> Column:
    return lookup(signals.LANGUAGE_OF_EXTENSION, F.lower(extname(basename(path))))


def is_source_file(language: Column) -> Column:
    return F.coalesce(language.isin(*signals.SOURCE_LANGUAGES), F.lit(False))


def is_test_file(path: Column) -> Column:
    name = basename(path)
    by_name = F.lit(False)
    for rx in signals.TEST_NAME_REGEXES:
        by_name = by_name | name.rlike(to_java(rx))
    return by_name | any_of(path, signals.TEST_PATH_FRAGMENTS)


def is_schema_file(path: Column) -> Column:
    """Database schema files."""
    name = basename(path)
    return (
        name.isin("schema.prisma", "schema.sql", "schema.rb", "db.ts", "db.js")
        | (name.endswith(".sql") & path.contains("schema"))
        | (path.contains("prisma/") & name.endswith(".prisma"))
    )


def migration_hits(path: Column) -> Column:
    """How many migration directories the path matches (a file may count more than once)."""
    fits = any_of(basename(path), signals.MIGRATION_EXTENSIONS, "endswith")
    hits = sum((path.contains(d).cast("int") for d in signals.MIGRATION_DIRS), F.lit(0))
    return F.when(fits, hits).otherwise(F.lit(0))


def classify(path: Column, size_bytes: Column, data_size_limit: int | None = None) -> Column:
    """File class from path and size."""
    name = basename(path)
    return _class_of(path, name, F.lower(extname(name)), language_of(path), size_bytes, data_size_limit)


def _class_of(path: Column, name: Column, ext: Column, language: Column, size_bytes: Column, data_size_limit: int | None = None) -> Column:
    """The order of the rules matters.  Only with ``data_size_limit`` a larger file of no known kind is data."""
    schema = (
        ext.isin(*signals.SCHEMA_EXTENSIONS)
        | name.rlike(r"(?i)^(?:schema|models|types)\.")
        | in_directory(path, signals.SCHEMA_DIRS, or_name=True)
    )
    large = F.lit(False) if data_size_limit is None else size_bytes > data_size_limit
    return (
        F.when(name.isin(*signals.LOCKFILE_FORMATS), F.lit("lockfile"))
        .when(name.rlike(r"^\.env(?:\.|\z)"), F.lit("env"))
        .when(ext.isin(*signals.BINARY_EXTENSIONS), F.lit("binary"))
        .when(ext.isin(*signals.DATA_EXTENSIONS), F.lit("data"))
        .when(schema, F.lit("schema"))
        .when(ext.isin(*signals.DOC_EXTENSIONS), F.lit("docs"))
        .when(ext.isin(*signals.SCRIPT_EXTENSIONS) | name.isin(*signals.SCRIPT_NAMES), F.lit("script"))
        .when(
            ext.isin(*signals.SOURCE_EXTENSIONS) | (language.isNotNull() & ~language.isin(*signals.CONFIG_LANGUAGES)),
            F.lit("source"),
        )
        .when(ext.isin(*signals.CONFIG_EXTENSIONS), F.lit("config"))
        .when(large, F.lit("data"))
        .otherwise(F.lit("source"))
    )


def binary_format(path: Column) -> Column:
    ext = F.lower(extname(basename(path)))
    return F.coalesce(lookup(signals.MIME_OF_EXTENSION, ext), F.lit("application/octet-stream"))


def is_binary_content(content: Column) -> Column:
    """More than 1 % NUL bytes among the first 8000.  Works on BINARY and STRING columns."""
    head = F.substring(content, 1, 8000)
    nul = F.length(head) - F.length(F.replace(head, F.lit("\0"), F.lit("")))
    return nul > F.lit(0.01) * F.length(head)


# ---------------------------------------------------------------- content


def first_lines(content: Column, n: int) -> Column:
    return F.substring_index(content, "\n", n)


def has_generated_marker(head: Column) -> Column:
    """One of the first lines says that the file is generated."""
    return any_of(head, signals.GENERATED_MARKERS)


def generator_of(path: Column, head: Column) -> Column:
    return (
        F.when(head.contains("prisma"), F.lit("Prisma"))
        .when(head.contains("graphql-codegen") | head.contains("GraphQL Code Generator"), F.lit("GraphQL Codegen"))
        .when(head.contains("openapi-generator") | head.contains("OpenAPI Generator"), F.lit("OpenAPI Generator"))
        .when(head.contains("protoc"), F.lit("Protobuf"))
        .when(path.endswith(".d.ts"), F.lit("TypeScript Declaration"))
    )


def extraction_type(path: Column, base: Column, size_bytes: Column, content: Column, head: Column, is_symlink: Column,
                    data_size_limit: int | None = None) -> Column:
    """Class after reading: binary sniff, files above ``data_size_limit`` (none by default) as data, generated files; symlinks are
    'unknown'."""
    binary = is_binary_content(content)
    generated = (
        in_directory(path, signals.GENERATED_DIRS, or_name=True)
        | path.endswith(".d.ts")
        | ((base == "source") & has_generated_marker(head))
    )
    data = base == "data"
    if data_size_limit is not None:
        data = data | (size_bytes > data_size_limit)
    return (
        F.when(is_symlink, F.lit("unknown"))
        .when(base == "binary", base)
        .when(base.isin("lockfile", "env"), F.when(binary, F.lit("error")).otherwise(base))
        .when(binary, F.lit("binary"))
        .when(data, F.lit("data"))
        .when(generated, F.lit("generated"))
        .otherwise(base)
    )


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row: a filter on it is not pushed below (and its expression repeated),
    because it comes out of a generator.  Filters on the other columns still pass."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def catalog(files: DataFrame, read: bool = True, data_size_limit: int | None = None) -> DataFrame:
    """The file catalog: excluded paths dropped, name, extension, language, size and class added.

    With ``read`` the extraction type (which looks into ``content``) replaces the class by path and ``content`` is kept;
    without it nothing but paths and sizes is read.
    """
    kept = drop_excluded_paths(files.withColumn("path", normalize_path(F.col("path"))))
    if "size_bytes" not in kept.columns:
        kept = kept.withColumn("size_bytes", F.octet_length("content").cast("long"))
    if "is_symlink" not in kept.columns:
        kept = kept.withColumn("is_symlink", F.lit(False))
    path = F.col("path")
    named = kept.select(
        "repo_id", "path", basename(path).alias("name"), "size_bytes", "is_symlink", *(["content"] if read else [])
    ).withColumn("ext", F.lower(extname(F.col("name"))))
    lang = named.withColumn("language", F.when(~F.col("is_symlink"), lookup(signals.LANGUAGE_OF_EXTENSION, F.col("ext"))))
    file_class = _class_of(path, F.col("name"), F.col("ext"), F.col("language"), F.col("size_bytes"), data_size_limit)
    front = ["repo_id", "path", "name", "ext", "size_bytes", "language", "is_symlink"]
    if not read:
        # a plain column, so that a query which does not ask for the class does not pay for it
        return lang.select(*front, file_class.alias("file_class"))
    base = _once(lang, "file_class", file_class)
    base = base.withColumn("_head", first_lines(F.col("content"), 10))
    kind = extraction_type(path, F.col("file_class"), F.col("size_bytes"), F.col("content"), F.col("_head"), F.col("is_symlink"), data_size_limit)
    return _once(base, "extraction_type", kind).select(*front, "extraction_type", "content")


def data_format(ext: Column, head: Column) -> Column:
    trimmed = F.regexp_extract(head, to_java(r"^\s*(\S)"), 1)
    return (
        F.when((ext == ".log") | head.rlike(r"\d{4}-\d{2}-\d{2}T\d{2}:\d{2}"), F.lit("log"))
        .when(ext == ".csv", F.lit("csv"))
        .when(ext == ".tsv", F.lit("tsv"))
        .when(ext.isin(".jsonl", ".ndjson"), F.lit("ndjson"))
        .when((ext == ".sql") | head.contains("INSERT INTO") | head.contains("CREATE TABLE"), F.lit("sql-dump"))
        .when(ext == ".xml", F.lit("xml"))
        .when(trimmed.isin("{", "["), F.lit("json-data"))
        .when(ext.isin(".dump", ".bak", ".backup"), F.lit("backup"))
        .when(ext.isin(".db", ".sqlite", ".sqlite3"), F.lit("sqlite"))
        .otherwise(F.lit("unknown"))
    )


def characterize_data(ext: Column, content: Column) -> tuple[Column, Column]:
    """(format, sample): the first 50 lines, and the last 20 after an ellipsis when lines are left out."""
    head = first_lines(content, signals.DATA_HEAD_LINES)
    tail = F.substring_index(content, "\n", -signals.DATA_TAIL_LINES)
    lines = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1
    long = lines > signals.DATA_HEAD_LINES + signals.DATA_TAIL_LINES
    sample = F.when(long, F.concat(head, F.lit("\n...\n"), tail)).otherwise(head)
    return data_format(ext, head), sample


def cap_content(content: Column, limit: int | None = None) -> Column:
    """The whole text, or its first ``limit`` characters for a caller who stores no more."""
    return content if limit is None else F.left(content, F.lit(limit))


def lockfile_summary(cat: DataFrame) -> DataFrame:
    """Format by file name; number of version lines, else of lines that begin with a letter or '@'."""
    locks = cat.filter(F.col("extraction_type") == "lockfile")
    versions = F.regexp_count("content", F.lit(to_java(r"""^\s+"?version"?:""", "m")))
    letters = F.regexp_count("content", F.lit(r"(?m)^[a-zA-Z@]"))
    return locks.select(
        "repo_id", "path",
        F.coalesce(lookup(signals.LOCKFILE_FORMATS, F.col("name")), F.lit("unknown")).alias("lockfile_format"),
        F.when(versions > 0, versions).otherwise(letters).alias("dependency_count"),
    )


# ---------------------------------------------------------------- directories


def key_directories(files: DataFrame) -> DataFrame:
    """Distinct directories whose name has a role."""
    kept = drop_excluded_paths(files.select("repo_id", "path"))
    names = F.slice(parts(F.col("path")), 1, F.size(parts(F.col("path"))) - 1)
    dirs = kept.select("repo_id", names.alias("d")).distinct()
    each = dirs.select("repo_id", "d", F.posexplode("d").alias("i", "name"))
    role = each.withColumn("role", lookup(signals.ROLE_OF_DIRECTORY, F.col("name"))).filter("role is not null")
    return role.select("repo_id", F.array_join(F.slice("d", F.lit(1), F.col("i") + 1), "/").alias("path"), "role").distinct()


def directory_listing(files: DataFrame) -> DataFrame:
    """Every directory's children, directories first, then by name: (repo_id, directory, name, is_directory, sort_key).

    ``sort_key`` orders siblings as text, so a reader sorts a directory (or the whole table, range-partitioned)
    without ranking a large directory in one task.
    """
    kept = drop_excluded_paths(files.select("repo_id", "path"))
    p = parts(F.col("path"))
    levels = kept.select("repo_id", p.alias("p"), F.explode(F.sequence(F.lit(1), F.size(p))).alias("depth"))
    nodes = levels.select(
        "repo_id",
        F.array_join(F.slice("p", F.lit(1), F.col("depth") - 1), "/").alias("directory"),
        F.element_at("p", F.col("depth")).alias("name"),
        (F.col("depth") < F.size("p")).alias("is_directory"),
    ).distinct()
    key = F.concat(F.when(F.col("is_directory"), F.lit("0")).otherwise(F.lit("1")), F.col("name"))
    return nodes.withColumn("sort_key", key)


def workspace_packages(files: DataFrame) -> DataFrame:
    """Workspace members: manifests below the top directory, with the name that package.json states."""
    path = F.col("path")
    hits = drop_excluded_paths(files).filter(basename(path).isin(*signals.WORKSPACE_MANIFESTS) & path.contains("/"))
    name = F.get_json_object(F.col("content"), "$.name")
    quoted = F.col("content").rlike(r'"name"\s*:\s*"')  # only a string is a name
    named = F.when((basename(path) == "package.json") & quoted & (name != ""), name)
    return hits.select("repo_id", dirname(path).alias("package_path"), path.alias("manifest_path"), named.alias("package_name"))


# ---------------------------------------------------------------- aggregates


def language_inventory(cat: DataFrame) -> DataFrame:
    """Files per source language with the repository's primary language (most files, then first path)."""
    src = cat.filter(is_source_file(F.col("language")))
    counts = src.groupBy("repo_id", "language").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))
    # at most one row per known language meets here
    best = counts.groupBy("repo_id").agg(
        F.min_by("language", F.struct((-F.col("files")).alias("n"), F.col("first_path"))).alias("primary_language")
    )
    return counts.join(best, "repo_id").select("repo_id", "language", "files", "primary_language")


def primary_language(cat: DataFrame) -> DataFrame:
    """One row per repository, 'Unknown' without source files."""
    found = language_inventory(cat).select("repo_id", "primary_language").distinct()
    repos = cat.select("repo_id").distinct()
    return repos.join(found, "repo_id", "left").select(
        "repo_id", F.coalesce("primary_language", F.lit("Unknown")).alias("primary_language")
    )


def file_counts(cat: DataFrame) -> DataFrame:
    def n(cond: Column) -> Column:
        return F.count_if(cond)

    kind = F.col("extraction_type")
    return cat.groupBy("repo_id").agg(
        n(~F.col("is_symlink")).alias("total_files"), n(F.col("is_symlink")).alias("symlinks"),
        n(kind == "binary").alias("binary_files"), n(kind == "generated").alias("generated_files"),
        n(kind == "data").alias("data_files"), n(kind == "error").alias("error_files"),
    )


def type_breakdown(cat: DataFrame) -> DataFrame:
    return cat.groupBy("repo_id", "extraction_type").agg(F.count("*").alias("files"))


def top_level_dirs(cat: DataFrame) -> DataFrame:
    return cat.groupBy("repo_id", F.substring_index("path", "/", 1).alias("top_dir")).agg(F.count("*").alias("files"))
