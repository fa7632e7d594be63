"""Queries of the file catalog and extraction operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bindings import relations as rel
from bindings.templates import SYMLINK_PATHS
from factloom import signals
from factloom.functions import paths
from factloom.operators import env, files, infra, manifests, symbols


def _files(spark, sf) -> DataFrame:
    f = rel.corpus_files(spark, sf)
    return f.withColumn("is_symlink", F.col("path").isin(*SYMLINK_PATHS)).withColumn(
        "size_bytes", F.octet_length("content").cast("long")
    )


def _catalog(spark, sf) -> DataFrame:
    return files.catalog(_files(spark, sf))


def _repo_files(spark, sf) -> DataFrame:
    return files.drop_excluded_paths(rel.repo_files(spark, sf))


def _repo_catalog(spark, sf) -> DataFrame:
    f = rel.repo_files(spark, sf)
    return files.catalog(f.withColumn("is_symlink", F.col("path").isin(*SYMLINK_PATHS)))


def file_catalog(spark, sf) -> DataFrame:
    return _catalog(spark, sf).drop("content")


def drop_excluded_paths(spark, sf) -> DataFrame:
    return files.drop_excluded_paths(rel.corpus_files(spark, sf)).groupBy("repo_id").agg(F.count("*").alias("files"))


def normalize_path(spark, sf) -> DataFrame:
    names = rel.table(spark, sf, "part").select("p_partkey", F.concat_ws("\\", "p_brand", "p_type", "p_name").alias("raw"))
    return names.select("p_partkey", paths.normalize_path(F.col("raw")).alias("path"))


def repo_name_from_remote(spark, sf) -> DataFrame:
    c = F.col("c_custkey").cast("string")
    remote = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("git@host.example:team/app-"), c, F.lit(".git"))).otherwise(
        F.concat(F.lit("https://host.example/team/app-"), c)
    )
    return rel.table(spark, sf, "customer").select("c_custkey", paths.repo_name_from_remote(remote).alias("repo_name"))


def language_of(spark, sf) -> DataFrame:
    f = _files(spark, sf).filter("not is_symlink")
    lang = files.language_of(F.col("path"))
    return f.select("repo_id", "path", lang.alias("language"), files.is_source_file(lang).alias("is_source"))


def key_directories(spark, sf) -> DataFrame:
    return files.key_directories(rel.corpus_files(spark, sf))


def directory_listing(spark, sf) -> DataFrame:
    return files.directory_listing(rel.corpus_files(spark, sf))


def classify_file(spark, sf) -> DataFrame:
    f = _files(spark, sf)
    return f.select("repo_id", "path", files.classify(F.col("path"), F.col("size_bytes"), signals.DATA_SIZE_LIMIT).alias("file_class"))


def refine_extraction_type(spark, sf) -> DataFrame:
    cat = files.catalog(_files(spark, sf), data_size_limit=signals.DATA_SIZE_LIMIT)
    head = files.first_lines(F.col("content"), 10)
    gen = F.when(F.col("extraction_type") == "generated", files.generator_of(F.col("path"), head))
    return cat.select("repo_id", "path", "extraction_type", gen.alias("generator"))


def binary_format(spark, sf) -> DataFrame:
    cat = _catalog(spark, sf).filter("extraction_type = 'binary'")
    return cat.select("repo_id", "path", files.binary_format(F.col("path")).alias("mime"))


def characterize_data(spark, sf) -> DataFrame:
    """Of every text of the corpus, as if it were a data file."""
    f = rel.corpus_files(spark, sf)
    fmt, sample = files.characterize_data(F.lower(paths.extname(paths.basename(F.col("path")))), F.col("content"))
    return f.select("repo_id", "path", fmt.alias("data_format"), F.sha2(sample, 256).alias("sample_hash"))


def cap_content(spark, sf) -> DataFrame:
    docs = rel.table(spark, sf, "documents")
    return docs.select("doc_id", F.length(files.cap_content(F.col("text"), 5000)).alias("kept_chars"), F.length(files.cap_content(F.col("text"), signals.STORED_TEXT_LIMIT)).alias("kept_default"))


def is_test_file(spark, sf) -> DataFrame:
    return rel.corpus_files(spark, sf).filter(files.is_test_file(F.col("path"))).select("repo_id", "path")


def schema_and_migration_files(spark, sf) -> DataFrame:
    f = rel.corpus_files(spark, sf)
    out = f.select("repo_id", "path", files.is_schema_file(F.col("path")).alias("is_schema"), files.migration_hits(F.col("path")).alias("migration_hits"))
    return out.filter("is_schema or migration_hits > 0")


def language_inventory(spark, sf) -> DataFrame:
    return files.language_inventory(files.catalog(_files(spark, sf), read=False))


def file_counts(spark, sf) -> DataFrame:
    return files.file_counts(_catalog(spark, sf))


def extraction_type_breakdown(spark, sf) -> DataFrame:
    return files.type_breakdown(_catalog(spark, sf))


def top_level_dirs(spark, sf) -> DataFrame:
    return files.top_level_dirs(files.catalog(_files(spark, sf), read=False))


def explode_lines(spark, sf) -> DataFrame:
    docs = rel.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return docs.select("doc_id", (F.col("i") + 1).alias("line_no"), F.length("line").alias("chars"))


def lockfile_deps(spark, sf) -> DataFrame:
    return files.lockfile_summary(_repo_catalog(spark, sf))


def source_symbols(spark, sf) -> DataFrame:
    s = symbols.source_symbols(_repo_catalog(spark, sf))
    lists = [F.array_join(c, ",").alias(c) for c in ("exports", "imports", "functions", "classes", "decorators")]
    return s.select("repo_id", "path", *lists, "has_default_export")


def env_file_keys(spark, sf) -> DataFrame:
    return env.env_file_keys(_repo_catalog(spark, sf)).withColumn("keys", F.array_join("keys", ","))


def env_definitions(spark, sf) -> DataFrame:
    return env.env_definitions(_repo_files(spark, sf))


def env_references(spark, sf) -> DataFrame:
    return env.env_references(_repo_files(spark, sf))


def env_inventory(spark, sf) -> DataFrame:
    return env.env_inventory(_repo_files(spark, sf))


def env_undeclared(spark, sf) -> DataFrame:
    return env.env_undeclared(_repo_files(spark, sf))


def env_required_optional(spark, sf) -> DataFrame:
    return env.required_and_optional(env.env_inventory(_repo_files(spark, sf)))


def env_listing(spark, sf) -> DataFrame:
    return env.env_listing(env.env_inventory(_repo_files(spark, sf)))


def manifest_dependencies(spark, sf) -> DataFrame:
    return manifests.dependencies(manifests.manifests(_repo_files(spark, sf), toml=False))


def manifest_dependencies_toml(spark, sf) -> DataFrame:
    return manifests.dependencies(manifests.manifests_toml(manifests.manifest_files(_repo_files(spark, sf))))


def ci_workflows(spark, sf) -> DataFrame:
    w = infra.ci_workflows(_repo_files(spark, sf))
    return w.select("repo_id", "path", "workflow", F.array_join("triggers", ",").alias("triggers"), F.array_join("jobs", ",").alias("jobs"))


def exposed_ports(spark, sf) -> DataFrame:
    return infra.exposed_ports(_repo_files(spark, sf))


def make_targets(spark, sf) -> DataFrame:
    return infra.make_targets(_repo_files(spark, sf))


def package_names(spark, sf) -> DataFrame:
    return files.workspace_packages(_repo_files(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        file_catalog, drop_excluded_paths, normalize_path, repo_name_from_remote, language_of, key_directories,
        directory_listing, classify_file, refine_extraction_type, binary_format, characterize_data, cap_content, is_test_file,
        schema_and_migration_files, language_inventory, file_counts, extraction_type_breakdown, top_level_dirs, explode_lines,
        lockfile_deps, source_symbols, env_file_keys, env_definitions, env_references, env_inventory, env_undeclared,
        env_required_optional, env_listing, manifest_dependencies, manifest_dependencies_toml, ci_workflows, exposed_ports,
        make_targets, package_names,
    )
}
