"""Pattern store, audit files, fitness log and fact exports."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from factloom.functions.checkpoints import stored
from factloom.operators.attest import ENTRY_FIELDS, ENTRY_SCHEMA
from factloom.operators.patterns import VALID_KEY

PATTERN_SCHEMA = (
    "schema_version string, pattern_id string, fingerprint string, status string, created_at timestamp, updated_at timestamp, "
    "last_used_at timestamp, fitness struct<use_count:long,probation_uses:long,success_count:long,avg_savings:double,"
    "fitness_score:double,fitness_history:array<struct<date:string,score:double,use_count:long>>>, "
    "stack_patterns struct<entry_points:array<string>,layers:string,auth_pattern:string,db_pattern:string,test_pattern:string,"
    "infra_pattern:string>, analysis_sequence array<string>, common_gaps array<struct<dimension:string,gap:string,severity:string,"
    "frequency:double>>"
)


# ---------------------------------------------------------------- pattern store


#
# <path>/data/commit=<id>/bucket=<n>/   documents as JSON lines; a key lies in the bucket of its crc32
# <path>/pointer/<version>/             which commit holds each bucket, at most one row a bucket
#
# An upsert rewrites the buckets it touches under a new commit and then adds a pointer.  Readers take the newest pointer, so they see
# all of an upsert or nothing; two writers of one version collide on its folder, and the later one fails.


BUCKETS = 256
_KEY = re.compile(VALID_KEY.replace(r"\z", r"\Z"))


def _bucket(key: Column) -> Column:
    return (F.crc32(key) % BUCKETS).cast("int")


def _pointer(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """Newest version and its commit of each bucket; (0, {}) for a store that is not there yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/pointer")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in files.listStatus(folder)] if files.exists(folder) else []
    done = [int(p.getName()) for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    if not done:
        return 0, {}
    rows = spark.read.schema("bucket int, commit string").json(f"{path}/pointer/{max(done)}").collect()
    return max(done), {r.bucket: r.commit for r in rows}


def _documents(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """Documents that parse and have a valid key; others are skipped."""
    if not folders:
        return spark.createDataFrame([], PATTERN_SCHEMA)
    raw = spark.read.schema(PATTERN_SCHEMA).option("mode", "DROPMALFORMED").json(list(folders))
    return raw.filter(F.col("fingerprint").rlike(VALID_KEY))


def _newest(docs: DataFrame) -> DataFrame:
    """The document of each key with the latest ``updated_at``, then the largest ``pattern_id``."""
    rest = [c for c in docs.columns if c != "fingerprint"]
    newest = docs.groupBy("fingerprint").agg(F.max_by(F.struct(*rest), F.struct("updated_at", "pattern_id")).alias("d"))
    return newest.select("d.*", "fingerprint").select(*docs.columns)


def store_folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the current documents, one a bucket."""
    return [f"{path}/data/commit={c}/bucket={b}" for b, c in sorted(_pointer(spark, path)[1].items())]


def upsert_patterns(patterns: DataFrame, path: str) -> None:
    """Write pattern documents; each replaces the older document of its key (of several, the newest counts).

    A key with unsafe characters, or none, fails the write before anything is visible.  Only buckets with a written key are read and
    rewritten.
    """
    spark = patterns.sparkSession
    key = F.col("fingerprint")
    message = F.concat(F.lit("invalid fingerprint: "), F.coalesce(key, F.lit("null")))
    checked = F.when(F.coalesce(key.rlike(VALID_KEY), F.lit(False)), key).otherwise(F.raise_error(message).cast("string"))
    names = spark.createDataFrame([], PATTERN_SCHEMA).columns
    coming = stored(_newest(patterns.withColumn("fingerprint", checked).select(*names)), "upsert")
    touched = [r[0] for r in coming.select(_bucket(key).alias("b")).distinct().collect()]
    version, commits = _pointer(spark, path)
    if not touched:
        return
    current = _documents(spark, [f"{path}/data/commit={commits[b]}/bucket={b}" for b in touched if b in commits])
    commit = uuid.uuid4().hex
    merged = _newest(current.unionByName(coming)).withColumn("bucket", _bucket(key))
    merged.repartition("bucket").write.partitionBy("bucket").mode("errorifexists").json(f"{path}/data/commit={commit}")
    now = sorted({**commits, **dict.fromkeys(touched, commit)}.items())
    spark.createDataFrame(now, "bucket int, commit string").coalesce(1).write.mode("errorifexists").json(f"{path}/pointer/{version + 1}")


def read_pattern_store(spark: SparkSession, path: str) -> DataFrame:
    """The current document of every fingerprint; documents that do not parse are skipped."""
    return _documents(spark, store_folders(spark, path))


def compact_pattern_store(spark: SparkSession, path: str, target: str) -> None:
    """Write the current documents to a new store."""
    upsert_patterns(read_pattern_store(spark, path), target)


def get_pattern(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Current document of one fingerprint, read from its bucket alone; a key with unsafe characters is an error."""
    if not _KEY.match(fingerprint):
        raise ValueError(f"invalid fingerprint: {fingerprint!r}")
    bucket = zlib.crc32(fingerprint.encode()) % BUCKETS
    commit = _pointer(spark, path)[1].get(bucket)
    return _documents(spark, [f"{path}/data/commit={commit}/bucket={bucket}"] if commit else []).filter(F.col("fingerprint") == fingerprint)


def flatten_patterns(docs: DataFrame) -> DataFrame:
    """Documents to the flat columns the matching operators take; store order is by fingerprint."""
    return docs.select(
        "pattern_id", "fingerprint", F.col("fingerprint").alias("store_ord"), "status", "last_used_at",
        "fitness.use_count", "fitness.probation_uses", "fitness.success_count", "fitness.avg_savings", "fitness.fitness_score",
    )


# ---------------------------------------------------------------- audit files


def write_attestations(entries: DataFrame, path: str) -> None:
    """Append entries as JSON lines with the member names of the audit format, plus ``chain_id``."""
    members = [F.col(name).alias(js) for js, name, _ in ENTRY_FIELDS]
    entries.select("chain_id", *members, F.col("this_hash").alias("thisHash")).write.mode("append").option("ignoreNullFields", False).json(path)


def read_attestations(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"chain_id long, {ENTRY_SCHEMA}").json(path)
    return raw.select("chain_id", *[F.col(js).alias(name) for js, name, _ in ENTRY_FIELDS], F.col("thisHash").alias("this_hash"))


# ---------------------------------------------------------------- logs and exports


def append_fitness_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def snake_case(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", lambda m: "_" + m[1].lower(), name)


def snake_type(kind: DataType) -> DataType:
    """A type with the fields of all its structs, in arrays and map values as well, under snake_case names."""
    if isinstance(kind, StructType):
        return StructType([StructField(snake_case(f.name), snake_type(f.dataType), f.nullable) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(snake_type(kind.elementType), kind.containsNull)
    if isinstance(kind, MapType):
        return MapType(snake_type(kind.keyType), snake_type(kind.valueType), kind.valueContainsNull)
    return kind


def export_facts_json(facts: DataFrame, path: str) -> None:
    """Facts as JSON lines under snake_case names at every level; keys of maps are data and stay.  Nested fields are renamed by one
    cast a column.  Names that become equal are an error."""
    kinds = snake_type(facts.schema)
    for kind in _structs(kinds):
        if len(set(kind.names)) < len(kind.names):
            raise ValueError(f"names that differ in case only: {sorted(kind.names)}")
    columns = [F.col(f"`{old.name}`").cast(new.dataType).alias(new.name) for old, new in zip(facts.schema.fields, kinds.fields)]
    facts.select(*columns).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def _structs(kind: DataType) -> list[StructType]:
    if isinstance(kind, StructType):
        return [kind, *[s for f in kind.fields for s in _structs(f.dataType)]]
    if isinstance(kind, ArrayType):
        return _structs(kind.elementType)
    return _structs(kind.keyType) + _structs(kind.valueType) if isinstance(kind, MapType) else []
