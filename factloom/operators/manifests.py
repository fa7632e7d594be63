"""Dependency manifests of ten kinds, read in one pass over the manifest files."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import signals
from factloom.functions.arrays import posexplode_once
from factloom.functions.paths import basename
from factloom.functions.regex import WS_CHARS, sql_literal, to_java

_M = signals.MANIFEST_REGEXES
_DEP = "struct<dep:string,dep_version:string,is_dev:boolean>"
_MANIFEST = f"struct<name:string,version:string,scripts:map<string,string>,deps:array<{_DEP}>>"
_TOML_NAMES = ("Cargo.toml", "pyproject.toml")


def _rx(key: str, flags: str = "") -> str:
    return sql_literal(to_java(_M[key], flags))


def _dep(name: str, version: str, dev: str = "false") -> str:
    return f"named_struct('dep', {name}, 'dep_version', {version}, 'is_dev', {dev})"


def _manifest(deps: str, name: str = "cast(null as string)", version: str = "cast(null as string)", scripts: str = "null") -> str:
    return f"cast(named_struct('name', {name}, 'version', {version}, 'scripts', cast({scripts} as map<string,string>), 'deps', {deps}) as {_MANIFEST})"


def _entries(map_col: str, dev: str) -> str:
    """Entries of a JSON object in their written order."""
    pairs = f"coalesce(map_entries({map_col}), cast(array() as array<struct<key:string,value:string>>))"
    return f"transform({pairs}, e -> {_dep('e.key', 'e.value', dev)})"


_WS = sql_literal(WS_CHARS)
_TRIMMED = f"transform(split(content, '\\n', -1), l -> btrim(l, {_WS}))"

_PACKAGE_JSON = _manifest(
    f"concat({_entries('_js.dependencies', 'false')}, {_entries('_js.devDependencies', 'true')})",
    "_js.name", "_js.version", "_js.scripts",
)
_COMPOSER = _manifest(
    f"concat({_entries('_js.`require`', 'false')}, {_entries('_js.`require-dev`', 'true')})", "_js.name", "_js.version"
)
_REQUIREMENTS = _manifest(
    f"transform(filter({_TRIMMED}, l -> l RLIKE {_rx('requirement')} AND NOT startswith(l, '-')), l -> "
    + _dep(
        f"lower(regexp_extract(l, {_rx('requirement')}, 1))",
        f"coalesce(nullif(btrim(regexp_extract(l, {_rx('requirement')}, 2), {_WS}), ''), '*')",
    )
    + ")"
)
_GO_LINES = f"filter({_TRIMMED}, l -> NOT l RLIKE {_rx('go_module')} AND l RLIKE {_rx('go_require')})"
_GO_MOD = _manifest(
    f"transform({_GO_LINES}, l -> "
    + _dep(f"regexp_extract(l, {_rx('go_require')}, 1)", f"regexp_extract(l, {_rx('go_require')}, 2)")
    + ")",
    f"try_element_at(transform(filter({_TRIMMED}, l -> l RLIKE {_rx('go_module')}), l -> regexp_extract(l, {_rx('go_module')}, 1)), -1)",
)
_GRADLE = _manifest(
    f"transform(regexp_extract_all(content, {_rx('gradle')}, 0), m -> "
    + _dep(
        f"array_join(slice(split(regexp_extract(m, {_rx('gradle')}, 1), ':', -1), 1, 2), ':')",
        f"coalesce(try_element_at(split(regexp_extract(m, {_rx('gradle')}, 1), ':', -1), 3), '*')",
        "startswith(m, 'test')",
    )
    + ")"
)
_GEMFILE = _manifest(
    f"transform(regexp_extract_all(content, {_rx('gem', 'm')}, 0), m -> "
    + _dep(f"regexp_extract(m, {_rx('gem')}, 1)", f"coalesce(nullif(regexp_extract(m, {_rx('gem')}, 2), ''), '*')")
    + ")"
)
_POM = _manifest(
    "transform(coalesce(_xml.dependencies.dependency, array()), d -> "
    + _dep(
        "concat(coalesce(d.groupId, ''), ':', coalesce(d.artifactId, ''))", "coalesce(d.version, '*')",
        "coalesce(d.scope, 'compile') = 'test'",
    )
    + ")",
    "_xml.artifactId", "_xml.version",
)
_JSON_SCHEMA = (
    "name string, version string, scripts map<string,string>, dependencies map<string,string>, "
    "devDependencies map<string,string>, `require` map<string,string>, `require-dev` map<string,string>, _bad string"
)
_XML_SCHEMA = (
    "artifactId string, version string, dependencies struct<dependency: array<struct<groupId: string, "
    "artifactId: string, version: string, scope: string>>>, _bad string"
)


def _native(files: DataFrame) -> DataFrame:
    js = F.when(F.col("name").isin("package.json", "composer.json"), F.from_json("content", _JSON_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    xml = F.when(F.col("name") == "pom.xml", F.from_xml("content", _XML_SCHEMA, {"columnNameOfCorruptRecord": "_bad"}))
    parsed = files.select("repo_id", "path", "name", "content", js.alias("_js"), xml.alias("_xml"))
    picked = parsed.selectExpr(
        "repo_id", "path AS file", "CASE WHEN name = 'build.gradle.kts' THEN 'build.gradle' ELSE name END AS manifest_type",
        f"""CASE
          WHEN name = 'package.json' AND _js._bad IS NULL THEN {_PACKAGE_JSON}
          WHEN name = 'composer.json' AND _js._bad IS NULL THEN {_COMPOSER}
          WHEN name = 'requirements.txt' THEN {_REQUIREMENTS}
          WHEN name = 'go.mod' THEN {_GO_MOD}
          WHEN name IN ('build.gradle', 'build.gradle.kts') THEN {_GRADLE}
          WHEN name = 'Gemfile' THEN {_GEMFILE}
          WHEN name = 'pom.xml' AND _xml._bad IS NULL THEN {_POM} END AS m""",
    )
    # an array generator instead of a filter, so the parsing is not repeated below a pushed predicate
    kept = picked.select("repo_id", "file", "manifest_type", F.explode(F.filter(F.array("m"), lambda m: m.isNotNull())).alias("m"))
    return kept.select("repo_id", "file", "manifest_type", "m.*")


def _toml_manifest(kind: str, content: str):
    """(name, version, deps) of one TOML manifest, None when it does not parse."""
    try:
        doc = tomllib.loads(content)
    except (tomllib.TOMLDecodeError, TypeError):
        return None

    def table(node, key):
        value = node.get(key) if isinstance(node, dict) else None
        return value if isinstance(value, dict) else {}

    def text(node, key):
        return node[key] if isinstance(node.get(key), str) else None

    deps = []
    if kind == "Cargo.toml":
        for section, dev in (("dependencies", False), ("dev-dependencies", True)):
            for dep, spec in table(doc, section).items():
                version = spec if isinstance(spec, str) else table({"s": spec}, "s").get("version", "*")
                deps.append((dep, str(version), dev))
        package = table(doc, "package")
        return text(package, "name"), text(package, "version"), deps
    project, poetry = table(doc, "project"), table(table(doc, "tool"), "poetry")
    for section in ("dependencies", "optional-dependencies"):
        listed = project.get(section)
        for item in listed if isinstance(listed, list) else []:
            if found := re.match(_M["pep508_name"], item):
                deps.append((found[1].lower(), item[found.end():].strip() or "*", False))
    for section, dev in (("dependencies", False), ("dev-dependencies", True)):
        for dep, spec in table(poetry, section).items():
            if dev or dep != "python":
                # a table has no text form of its own in the report
                deps.append((dep.lower(), "[object Object]" if isinstance(spec, dict) else str(spec), dev))
    return text(project, "name") or text(poetry, "name"), text(project, "version") or text(poetry, "version"), deps


def manifests_toml(files: DataFrame) -> DataFrame:
    """Cargo.toml and pyproject.toml; the TOML parser is the only Python step."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for repo, path, name, content in pdf.itertuples(index=False):
                found = _toml_manifest(name, content)
                if found:
                    deps = [{"dep": d, "dep_version": v, "is_dev": dev} for d, v, dev in found[2]]
                    rows.append((repo, path, name, found[0], found[1], deps))
            yield pd.DataFrame(rows, columns=["repo_id", "file", "manifest_type", "name", "version", "deps"])

    toml = files.filter(F.col("name").isin(*_TOML_NAMES)).select("repo_id", "path", "name", "content")
    schema = f"repo_id string, file string, manifest_type string, name string, version string, deps array<{_DEP}>"
    out = toml.mapInPandas(parse, schema)
    return out.withColumn("scripts", F.lit(None).cast("map<string,string>")).select(
        "repo_id", "file", "manifest_type", "name", "version", "scripts", "deps"
    )


def manifest_files(files: DataFrame) -> DataFrame:
    return files.withColumn("name", basename(F.col("path"))).filter(F.col("name").isin(*signals.MANIFEST_NAMES))


def manifests(files: DataFrame, toml: bool = True) -> DataFrame:
    """(repo_id, file, manifest_type, name, version, scripts, deps); manifests that do not parse are left out."""
    wanted = manifest_files(files)
    native = _native(wanted.filter(~F.col("name").isin(*_TOML_NAMES)))
    return native.unionByName(manifests_toml(wanted)) if toml else native


def dependencies(found: DataFrame) -> DataFrame:
    """One row per dependency in manifest order: (repo_id, file, manifest_type, manifest_name, manifest_version,
    dep_pos, dep, dep_version, is_dev)."""
    rows = found.select(
        "repo_id", "file", "manifest_type", F.col("name").alias("manifest_name"),
        F.col("version").alias("manifest_version"), posexplode_once("deps").alias("i", "d"),
    )
    return rows.select(
        "repo_id", "file", "manifest_type", "manifest_name", "manifest_version", (F.col("i") + 1).alias("dep_pos"), "d.*"
    )
