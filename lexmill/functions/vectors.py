"""Vector expressions and identifiers, all JVM-side."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_embedding(text: Column, dim: int) -> Column:
    """Deterministic unit vector from the 32 bytes of SHA-256, repeated to ``dim``."""
    used = min(dim, 32)

    def from_digest(digest: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.lit(used - 1)),
            lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 - 0.5,
        )

    def unit(base: Column) -> Column:
        def term(i: Column) -> Column:
            return F.element_at(base, (i % used) + 1)

        total = F.aggregate(
            F.sequence(F.lit(0), F.lit(dim - 1)), F.lit(0.0), lambda acc, i: acc + term(i) * term(i)
        )
        # the array of one keeps the norm a bound variable instead of one sum per element
        return F.flatten(
            F.transform(
                F.array(F.sqrt(F.when(total == 0, 1.0).otherwise(total))),
                lambda norm: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: term(i) / norm),
            )
        )

    bytes_ = F.transform(F.array(F.sha2(F.coalesce(text, F.lit("")), 256)), from_digest)
    return F.flatten(F.transform(bytes_, unit))


def point_id(chunk_id: Column) -> Column:
    """60-bit identifier: the first 15 hex digits of SHA-256."""
    return F.conv(F.substring(F.sha2(chunk_id, 256), 1, 15), 16, 10).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))
