"""Centroid clustering in whole numbers with ns-bounds (norm of sums).

Every vector keeps the distance to each centroid as it was last evaluated, and the round of that evaluation.  A bound from round t is
loosened by the distance between the centroid's place in round t and its place now, which the history of centroids gives; adding up
the drifts of the rounds between would loosen it more.  Where the loosened bounds cannot rule a centroid out, its distance is counted
exactly.  All distances that decide are sums of squares of whole numbers; bounds are rounded to the safe side, so the result equals
that of comparing every vector with every centroid in every round.

State is one stored row per vector.  The driver holds centroids only: k vectors for each round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.checkpoints import discard, stored

SCALE = 256
#: components beyond this could take a squared distance of 64 components out of 64 bits
LARGEST = 1 << 27
CHUNK_ROWS, CHUNK_PAIRS = 4096, 1 << 16
SLACK = 1e-9


def whole_vectors(df: DataFrame, dims: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, v) of the rows whose vector has exactly ``dims`` components, none null or non-finite; v = floor(256 x)."""
    fits = F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    small = F.forall(whole, lambda x: F.abs(x) <= LARGEST)
    safe = F.when(small, whole).otherwise(F.raise_error(F.lit(f"a component of 256 x lies beyond {LARGEST}")).cast("array<bigint>"))
    return df.where(fits).select(F.col(key), safe.cast("array<int>").alias("v"))


def first_centroids(vectors: DataFrame, k: int, key: str, salt: str) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of 'salt:key' (null key: no digits); ties by their components."""
    ordered = vectors.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), "v")
    return np.array([r.v for r in ordered.select("v", key).limit(k).collect()], np.int64)


def _squares(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = v - c
    return np.einsum("ij,ij->i", gap, gap)


def _exact(v: np.ndarray, centroids: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    parts = [_squares(v[rows[i : i + CHUNK_PAIRS]], centroids[cols[i : i + CHUNK_PAIRS]]) for i in range(0, len(rows), CHUNK_PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _below(d2: np.ndarray) -> np.ndarray:
    """Square roots as 32-bit numbers that are not above the true ones."""
    return np.nextafter((np.sqrt(d2.astype(np.float64)) * (1 - SLACK)).astype(np.float32), np.float32(-np.inf))


def _above(d2: np.ndarray) -> np.ndarray:
    return np.sqrt(d2.astype(np.float64)) * (1 + SLACK)


def evaluate_all(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, ...]:
    """First round: (cluster, upper, upper_round, lower, lower_round)."""
    d2 = np.stack([_squares(v, c) for c in centroids], 1)
    cluster = np.argmin(d2, 1)  # the first of equal ones
    n, k = d2.shape
    return cluster, _above(d2[np.arange(n), cluster]), np.zeros(n, np.int64), _below(d2), np.zeros((n, k), np.int8)


def reassign(v: np.ndarray, state: tuple[np.ndarray, ...], history: np.ndarray, moved: np.ndarray) -> tuple[tuple[np.ndarray, ...], int]:
    """The state after one more round, and the number of distances that had to be counted.

    ``history[t]`` are the centroids of round t, the last those of now; ``moved[t, j]`` is how far centroid j lies from its place
    in round t.
    """
    cluster, upper, upper_round, lower, lower_round = (a.copy() for a in state)
    now, centroids = len(history) - 1, history[-1]
    n, k = lower.shape
    loose = lower.astype(np.float64) - moved[lower_round, np.arange(k)] * (1 + SLACK) - SLACK
    loose[np.arange(n), cluster] = np.inf
    reach = upper + moved[upper_round, cluster] * (1 + SLACK) + SLACK
    doubt = np.flatnonzero((loose <= reach[:, None]).any(1))
    # the own distance first: it often settles the row
    own = _exact(v, centroids, doubt, cluster[doubt])
    upper[doubt], upper_round[doubt] = _above(own), now
    at, other = np.nonzero(loose[doubt] <= (upper[doubt] + SLACK)[:, None])
    d2 = _exact(v, centroids, doubt[at], other)
    lower[doubt[at], other], lower_round[doubt[at], other] = _below(d2), now
    # least (distance, number) among the own centroid and those counted
    rows = np.concatenate((np.arange(len(doubt)), at))
    names, dist = np.concatenate((cluster[doubt], other)), np.concatenate((own, d2))
    order = np.lexsort((names, dist, rows))
    best = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
    changed = names[best] != cluster[doubt]
    gone, old = doubt[changed], cluster[doubt][changed]
    lower[gone, old], lower_round[gone, old] = _below(own[changed]), now
    cluster[gone], upper[gone] = names[best][changed], _above(dist[best][changed])
    return (cluster, upper, upper_round, lower, lower_round), len(own) + len(d2)


STATE = "v array<int>, cluster int, upper double, upper_round int, lower array<float>, lower_round array<tinyint>"


def _flat(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.ravel(), kind))


def _round(df: DataFrame, key: str, history: Sequence[np.ndarray], final: bool) -> DataFrame:
    """One assignment of all rows, with their new state or, at the end, (key, cluster, distance)."""
    past = np.stack(history)
    k, dims = past[-1].shape
    gaps = (past - past[-1]).astype(np.float64)
    moved = np.sqrt(np.einsum("tkd,tkd->tk", gaps, gaps))
    key_type = df.schema[key].dataType.simpleString()
    names = [key, "cluster", "distance"] if final else [key, *(c.split()[0] for c in STATE.split(", "))]
    schema = f"`{key}` {key_type}, " + ("cluster int, distance long" if final else STATE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, CHUNK_ROWS):
                rows = batch.slice(begin, CHUNK_ROWS)
                v = _flat(rows.column("v"), dims, np.int64)
                if len(past) == 1:
                    state = evaluate_all(v, past[0])
                else:
                    read = [rows.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "upper", "upper_round")]
                    state, _ = reassign(v, (*read, _flat(rows.column("lower"), k, np.float32), _flat(rows.column("lower_round"), k, np.int8)), past, moved)
                cluster = pa.array(state[0], pa.int32())
                if final:
                    out = [rows.column(key), cluster, pa.array(_squares(v, past[-1][state[0]]))]
                else:
                    out = [rows.column(key), rows.column("v"), cluster, pa.array(state[1]), pa.array(state[2], pa.int32()), _lists(state[3], pa.float32()), _lists(state[4], pa.int8())]
                yield pa.RecordBatch.from_arrays(out, names)

    return df.mapInArrow(run, schema)


def _moved_centroids(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor(sum / count) of each cluster; an empty one stays.  k rows come to the driver."""
    k, dims = centroids.shape
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[i].cast("long")) for i in range(dims)]).alias("s"))
    out = centroids.copy()
    for r in sums.collect():
        out[r.cluster] = [s // r.n for s in r.s]
    return out


def cluster_vectors(df: DataFrame, k: int, rounds: int, dims: int = 64, salt: str = "2", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every row with a whole vector of ``dims`` components.

    ``rounds`` times all vectors go to the nearest centroid (squared Euclidean distance of floor(256 x); ties: smaller number) and
    centroids become the floors of the means; then vectors are assigned once more.  Rows with a null vector, another length, or a
    null or non-finite component are left out; fewer than ``k`` rows give as many centroids as there are rows; an empty table gives no
    rows.  Repeated rows and null keys are rows like others.  A component with 256 x beyond 2^27 is an error.  Other columns are not
    read.
    """
    spark = df.sparkSession
    state = stored(whole_vectors(df, dims, key, vector), "vectors")
    start = first_centroids(state, k, key, salt)
    out = f"`{key}` {state.schema[key].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(start):
        return spark.createDataFrame([], out)
    history = [start]
    for _ in range(rounds):
        before, state = state, stored(_round(state, key, history, final=False), "assigned")
        discard(before)
        history.append(_moved_centroids(state, history[-1]))
    final = stored(_round(state, key, history, final=True), "clusters")
    discard(state)
    inertia = {r.cluster: int(r.s) for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    named = [(j, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, history[-1][j])).encode()).hexdigest()) for j in sorted(inertia)]
    # at most k rows
    facts = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
