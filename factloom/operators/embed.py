"""Hash embeddings and dimension normalization, in 1536 dimensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 1536
HASHES = DIMENSIONS * 4 // 32


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x * x))
    # the norm is bound once by a one-element transform instead of once per element
    bound = F.transform(F.array(F.struct(norm.alias("n"), vector.alias("v"))), lambda s: F.when(s["n"] == 0.0, s["v"]).otherwise(F.transform(s["v"], lambda x: x / s["n"])))
    return F.element_at(bound, 1)


def hash_embed(text: str) -> Column:
    """Embedding of a text column (name or SQL): 192 salted SHA-256 digests read as big-endian signed 32-bit integers,
    each mapped to i / 2^31 - 1, then unit length."""
    digests = f"transform(sequence(0, {HASHES - 1}), i -> sha2(concat(cast(i as string), ':', {text}), 256))"
    word = "cast(conv(substring(h, j * 8 + 1, 8), 16, 10) as bigint)"
    value = f"(({word} + 2147483648) % 4294967296 - 2147483648) / 2147483648D - 1D"
    return l2_normalize(F.expr(f"flatten(transform({digests}, h -> transform(sequence(0, 7), j -> {value})))"))


def normalize_dim(vector: Column, dims: int = DIMENSIONS) -> Column:
    """Pad with zeros, or average adjacent values, to ``dims``; unit length unless the size already fits."""
    v = F.transform(vector, lambda x: x.cast("double"))
    n = F.size(v)
    padded = F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dims) - n, F.lit(0))))

    def block(i: Column) -> Column:
        start = F.floor(i * (n / dims)).cast("int")
        end = F.least(F.floor((i + 1) * (n / dims)).cast("int"), n)
        part = F.slice(v, start + 1, F.greatest(end - start, F.lit(0)))
        return F.when(end > start, F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / (end - start)).otherwise(F.lit(0.0))

    averaged = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), block)
    return F.when(n == dims, v).when(n < dims, l2_normalize(padded)).otherwise(l2_normalize(averaged))
