"""Framework, database, authentication and test inventories of repositories.

Dictionaries are fixed and small, so they are expressions, not joins.  Every per-repository list below is bounded
by a dictionary; unbounded lists (key files, schema files) stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.checkpoints import cut
from factloom.functions.paths import basename, extname
from factloom.functions.ranking import first_per_key
from factloom.functions.regex import match_spans, sql_literal, to_java
from factloom.operators.files import any_of, is_schema_file, is_test_file, lookup, migration_hits

_EMPTY = "cast(array() as array<string>)"


def _signals_in(text: str, pairs) -> Column:
    """Values of all dictionary entries whose key occurs in ``text`` (SQL), in dictionary order."""
    entries = ", ".join(f"named_struct('i', {i}, 's', {sql_literal(s)}, 'v', {sql_literal(v)})" for i, (s, v) in enumerate(pairs))
    return F.expr(f"filter(array({entries}), e -> contains({text}, e.s))")


def _repos(files: DataFrame) -> DataFrame:
    return files.select("repo_id").distinct()


# ---------------------------------------------------------------- frameworks


def dep_frameworks(deps: DataFrame) -> DataFrame:
    """Dependencies that name a framework: exact dictionaries first, then substrings."""
    by_part = F.coalesce(*[F.when(F.col("dep").contains(s), F.lit(f)) for s, f in signals.FRAMEWORK_SUBSTRINGS])
    found = deps.withColumn("framework", F.coalesce(lookup(signals.FRAMEWORKS, F.col("dep")), by_part))
    return found.filter("framework is not null").select("repo_id", "file", "dep_pos", "dep", "framework")


def framework_ranks(deps: DataFrame) -> DataFrame:
    """(repo_id, framework, first_seen) in first-seen order of (manifest path, position)."""
    return dep_frameworks(deps).groupBy("repo_id", "framework").agg(F.min(F.struct("file", "dep_pos")).alias("first_seen"))


def framework_inventory(files: DataFrame, deps: DataFrame, found: DataFrame) -> DataFrame:
    """Per repository: primary, all and secondary frameworks, and the workspace tool."""
    ordered = framework_ranks(deps).groupBy("repo_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first_seen", "framework"))), lambda x: x["framework"]).alias("frameworks")
    )
    name = basename(F.col("path"))
    rank = F.coalesce(*[F.when(name == f, F.lit(i)) for i, (f, _) in enumerate(signals.WORKSPACE_TOOLS)])
    tools = files.groupBy("repo_id").agg(F.min(rank).alias("tool"))
    packages = found.groupBy("repo_id").agg(F.count_if(F.col("manifest_type") == "package.json").alias("packages"))
    joined = tools.join(ordered, "repo_id", "left").join(packages, "repo_id", "left")
    by_file = F.try_element_at(F.array(*[F.lit(t) for _, t in signals.WORKSPACE_TOOLS]), F.col("tool") + 1)
    tool = F.coalesce(by_file, F.when(F.col("packages") > 2, F.lit("npm workspaces")))
    frameworks = F.coalesce(F.col("frameworks"), F.expr(_EMPTY))
    primary = F.try_element_at(frameworks, F.lit(1))
    return joined.select(
        "repo_id", primary.alias("primary_framework"), frameworks.alias("frameworks"),
        F.array_except(frameworks, F.array(primary)).alias("secondary_frameworks"),
        tool.isNotNull().alias("is_monorepo"), tool.alias("monorepo_tool"),
    )


# ---------------------------------------------------------------- databases


def dep_db_engines(deps: DataFrame, files: DataFrame) -> DataFrame:
    """Distinct engines: dependency names that contain a signal, and the provider of the first Prisma schema."""
    hits = deps.select("repo_id", F.lower("dep").alias("d")).distinct()
    by_dep = hits.select("repo_id", F.explode(F.transform(_signals_in("d", signals.DB_ENGINES.items()), lambda e: e["v"])).alias("engine"))
    schemas = files.filter(basename(F.col("path")) == "schema.prisma").select("repo_id", "path", "content")
    first = first_per_key(schemas, ["repo_id"], [F.col("path")])
    provider = F.lower(F.regexp_extract("content", to_java(r"""provider\s*=\s*["'](\w+)["']"""), 1))
    by_schema = first.select("repo_id", lookup(signals.PRISMA_PROVIDERS, provider).alias("engine")).filter("engine is not null")
    return by_dep.unionByName(by_schema).distinct()


def dep_orm(deps: DataFrame, files: DataFrame) -> DataFrame:
    """First dependency that names an ORM, else what the files imply."""
    named = deps.withColumn("orm", lookup(signals.ORMS, F.col("dep"))).filter("orm is not null")
    by_dep = named.groupBy("repo_id").agg(F.min_by("orm", F.struct("file", "dep_pos")).alias("orm"))
    name = basename(F.col("path"))
    implied = files.groupBy("repo_id").agg(
        F.bool_or(name == "schema.prisma").alias("prisma"),
        F.bool_or(name.isin("drizzle.config.ts", "drizzle.config.js")).alias("drizzle"),
    )
    by_file = F.when(F.col("prisma"), F.lit("Prisma")).when(F.col("drizzle"), F.lit("Drizzle"))
    return implied.join(by_dep, "repo_id", "left").select("repo_id", F.coalesce("orm", by_file).alias("orm"))


def dep_migration_tool(deps: DataFrame, files: DataFrame) -> DataFrame:
    """First *signal* that any dependency contains, else what the files imply."""
    pairs = list(signals.MIGRATION_TOOLS.items())
    hit = F.array_min(F.transform(_signals_in("d", pairs), lambda e: e["i"]))
    by_dep = deps.select("repo_id", F.lower("dep").alias("d")).groupBy("repo_id").agg(F.min(hit).alias("i"))
    implied = files.groupBy("repo_id").agg(
        F.bool_or(F.col("path").contains("db/migrate/")).alias("rails"),
        F.bool_or(basename(F.col("path")) == "alembic.ini").alias("alembic"),
    )
    tool = F.try_element_at(F.array(*[F.lit(v) for _, v in pairs]), F.col("i") + 1)
    by_file = F.when(F.col("rails"), F.lit("Rails ActiveRecord")).when(F.col("alembic"), F.lit("Alembic"))
    return implied.join(by_dep, "repo_id", "left").select("repo_id", F.coalesce(tool, by_file).alias("migration_tool"))


def migration_count(files: DataFrame) -> DataFrame:
    return files.groupBy("repo_id").agg(F.sum(migration_hits(F.col("path"))).alias("migrations"))


def schema_files(files: DataFrame) -> DataFrame:
    return files.filter(is_schema_file(F.col("path"))).select("repo_id", "path")


def connection_env_vars(files: DataFrame) -> DataFrame:
    """Distinct known connection variables that dotenv and database config files mention."""
    name = basename(F.col("path"))
    config = (name.contains("database") | name.contains("db")) & extname(name).isin(".ts", ".js", ".py", ".rb")
    wanted = files.filter(name.startswith(".env") | name.endswith(".env") | config)
    names = ", ".join(sql_literal(n) for n in signals.CONNECTION_ENV_NAMES)
    mentioned = F.expr(f"filter(array({names}), n -> contains(content, n))")
    return wanted.select("repo_id", F.explode(mentioned).alias("env_name")).distinct()


def _bounded_list(df: DataFrame, column: str, name: str) -> DataFrame:
    """Sorted list per repository of a column whose values come from a fixed dictionary."""
    return df.groupBy("repo_id").agg(F.sort_array(F.collect_set(column)).alias(name))


def database_inventory(files: DataFrame, deps: DataFrame) -> DataFrame:
    empty = F.expr(_EMPTY)
    schema_count = files.groupBy("repo_id").agg(
        F.count_if(is_schema_file(F.col("path"))).alias("schema_files"),
        F.sum(migration_hits(F.col("path"))).alias("migrations"),
    )
    return (
        schema_count.join(dep_orm(deps, files), "repo_id").join(dep_migration_tool(deps, files), "repo_id")
        .join(_bounded_list(dep_db_engines(deps, files), "engine", "engines"), "repo_id", "left")
        .join(_bounded_list(connection_env_vars(files), "env_name", "connection_env_vars"), "repo_id", "left")
        .select(
            "repo_id", F.coalesce("engines", empty).alias("engines"), "orm", "migration_tool", "migrations", "schema_files",
            F.coalesce("connection_env_vars", empty).alias("connection_env_vars"),
        )
    )


def phi_tables(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Does any personal-data candidate lie in a file whose path starts with a schema file's path?

    A prefix join as an equi-join: a candidate path can only start with a schema path at one of the places where
    a schema file's name can end, so those prefixes are exploded and looked up.
    """
    schema = schema_files(files)
    paths = candidates.select("repo_id", "path").distinct()

    spans = paths.select("repo_id", F.col("path").alias("p"), F.explode(match_spans("path", r"\.(?:prisma|sql|rb|ts|js)")).alias("s"))
    prefixes = spans.select("repo_id", F.left("p", F.col("s.end_pos")).alias("path")).distinct()
    hits = prefixes.join(schema, ["repo_id", "path"], "left_semi").select("repo_id").distinct().withColumn("_hit", F.lit(True))
    return _repos(files).join(hits, "repo_id", "left").select("repo_id", F.col("_hit").isNotNull().alias("phi_tables"))


# ---------------------------------------------------------------- authentication


def dep_auth_type(deps: DataFrame) -> DataFrame:
    """Highest-priority authentication type that any dependency names."""
    rank = F.coalesce(*[F.when(F.lower("dep").isin(*names), F.lit(i)) for i, (_, names) in enumerate(signals.AUTH_DEPENDENCIES)])
    best = deps.groupBy("repo_id").agg(F.min(rank).alias("i")).filter("i is not null")
    types = F.array(*[F.lit(t) for t, _ in signals.AUTH_DEPENDENCIES])
    return best.select("repo_id", F.element_at(types, F.col("i") + 1).alias("auth_type"))


def auth_files(files: DataFrame) -> DataFrame:
    """(repo_id, auth_type, path): code files that show signs of an authentication type."""
    path = F.col("path")
    code = files.filter(
        extname(basename(path)).isin(*signals.AUTH_CODE_EXTENSIONS)
        & ~path.contains("node_modules") & ~path.contains(".test.") & ~path.contains(".spec.")
    )
    # two-step patterns such as 'authorization.*bearer' are checked as written; the union is one pass per type, over texts with a word of it
    worded = code.select("repo_id", "path", "content", F.lower("content").alias("_lower"))
    flags = [
        F.when(any_of(F.col("_lower"), signals.AUTH_FILE_WORDS[t]) & F.col("content").rlike("(?i)" + "|".join(f"(?:{to_java(rx)})" for rx in rxs)), F.lit(t))
        for t, rxs in signals.AUTH_FILE_REGEXES
    ]
    return worded.select("repo_id", F.explode(F.array_compact(F.array(*flags))).alias("auth_type"), "path")


def _route_facts(routes: DataFrame) -> DataFrame:
    return routes.groupBy("repo_id").agg(F.bool_and("auth_required").alias("all_auth"))


def auth_inventory(files: DataFrame, deps: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo_id, auth_type, source, key_files, covers_all_routes); 'unknown' when nothing is found."""
    path = F.col("path")
    by_dep = dep_auth_type(deps)
    named = files.filter(path.contains("auth") & extname(basename(path)).isin(".ts", ".js")).select("repo_id", "path")
    dep_files = by_dep.join(named, "repo_id").filter(F.lower("path").contains(F.col("auth_type")))
    guard = any_of(path, signals.GUARD_WORDS)

    def summed(df: DataFrame) -> DataFrame:
        return df.groupBy("repo_id", "auth_type").agg(F.count("*").alias("key_files"), F.bool_or(guard).alias("guarded"))

    dep_rows = by_dep.join(summed(dep_files), ["repo_id", "auth_type"], "left").withColumn("source", F.lit("dependency"))
    scanned = summed(auth_files(files)).join(by_dep, ["repo_id", "auth_type"], "left_anti").withColumn("source", F.lit("files"))
    # one row per repository and type, read twice; written once, the files are scanned once
    known = cut(dep_rows.unionByName(scanned))
    unknown = _repos(files).join(known.select("repo_id"), "repo_id", "left_anti").select(
        "repo_id", F.lit("unknown").alias("auth_type"), F.lit(0).cast("long").alias("key_files"), F.lit(False).alias("guarded"),
        F.lit("none").alias("source"),
    )
    covered = F.coalesce(F.col("all_auth").isNotNull() & (F.coalesce("guarded", F.lit(False)) | F.col("all_auth")), F.lit(False))
    return known.unionByName(unknown).join(_route_facts(routes), "repo_id", "left").select(
        "repo_id", "auth_type", "source", F.coalesce("key_files", F.lit(0).cast("long")).alias("key_files"),
        ((F.col("source") != "none") & covered).alias("covers_all_routes"),
    )


def first_auth_type(inventory: DataFrame) -> DataFrame:
    """The type a fingerprint uses: the dependency's, else the first scanned type in reporting order."""
    order = F.array(*[F.lit(t) for t, _ in signals.AUTH_FILE_REGEXES])
    rank = F.when(F.col("source") == "dependency", F.lit(0)).otherwise(F.array_position(order, F.col("auth_type")))
    return inventory.groupBy("repo_id").agg(F.min_by("auth_type", rank).alias("auth_type"))


# ---------------------------------------------------------------- tests


def dep_test_frameworks(deps: DataFrame) -> DataFrame:
    """Distinct test frameworks: the first signal each dependency contains."""
    lowered = {k.lower(): v for k, v in signals.TEST_FRAMEWORKS.items()}
    first = F.try_element_at(_signals_in("d", lowered.items()), F.lit(1))
    hits = deps.select("repo_id", F.lower("dep").alias("d")).distinct().select("repo_id", first["v"].alias("framework"))
    return hits.filter("framework is not null").distinct()


def coverage_tooling(deps: DataFrame, found: DataFrame) -> DataFrame:
    """Repositories with a coverage tool among dependencies or the word in a script."""
    by_dep = deps.filter(any_of(F.lower("dep"), signals.COVERAGE_TOOLS)).select("repo_id")
    by_script = found.filter(F.exists(F.map_values("scripts"), lambda s: s.contains("coverage"))).select("repo_id")
    return by_dep.unionByName(by_script).distinct()


def test_inventory(files: DataFrame, deps: DataFrame, found: DataFrame) -> DataFrame:
    path, name = F.col("path"), basename(F.col("path"))
    below = F.concat(F.lit("/"), path)
    counts = files.groupBy("repo_id").agg(
        F.count_if(is_test_file(path)).alias("test_files"),
        F.bool_or(name.endswith("_spec.rb")).alias("rspec"),
        F.bool_or(name.isin("pytest.ini", "conftest.py")).alias("pytest"),
        F.bool_or(name.endswith("_test.go")).alias("go_test"),
        F.bool_or(any_of(below, [f"/{d}/" for d in signals.COVERAGE_DIRS])).alias("coverage_directory"),
    )
    fallback = F.array_compact(F.array(
        F.when(F.col("rspec"), F.lit("RSpec")), F.when(F.col("pytest"), F.lit("pytest")), F.when(F.col("go_test"), F.lit("Go test"))
    ))
    tooling = coverage_tooling(deps, found).withColumn("_cov", F.lit(True))
    by_dep = _bounded_list(dep_test_frameworks(deps), "framework", "by_dep")
    return counts.join(by_dep, "repo_id", "left").join(tooling, "repo_id", "left").select(
        "repo_id", "test_files", F.coalesce("by_dep", fallback).alias("test_frameworks"),
        F.col("_cov").isNotNull().alias("coverage_tooling"), "coverage_directory",
    )


# ---------------------------------------------------------------- listings


def dependency_listing(deps: DataFrame) -> DataFrame:
    """``name@version`` rows under production / development with the size of each section."""
    sections = deps.groupBy("repo_id", "is_dev").agg(F.count("*").alias("section_size"))
    return deps.join(sections, ["repo_id", "is_dev"]).select(
        "repo_id", "is_dev", "file", "dep_pos", F.concat_ws("@", "dep", "dep_version").alias("label"), "section_size"
    )


def runtime_of(language: Column) -> Column:
    return lookup(signals.RUNTIMES, language)
