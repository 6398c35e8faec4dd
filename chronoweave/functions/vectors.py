"""Vector similarity on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; null if a vector is null, of another length, or all zero."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (size > 0), dot(x, y) / size)


def usable(v: Column | str, dimensions: int) -> Column:
    """An array of ``dimensions`` numbers without null and NaN that aren't all zero."""
    return F.coalesce((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), F.lit(False))


def hashed_embedding(text: Column | str, dimensions: int = 64) -> Column:
    """A deterministic vector of a text, the stand-in for a model: numbers from -1 to 1 out of its hash; null for null."""
    low = F.lower(F.trim(text))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(dimensions)), lambda i: (F.pmod(F.xxhash64(low, i), F.lit(2_000_001)) / 1_000_000 - 1).cast("float"))
    return F.when(low.isNotNull(), numbers)


def enriched(entities: DataFrame, embed=hashed_embedding, most: int = 100) -> DataFrame:
    """``entity_id``, ``embedding`` of the next ``most`` live entities that have none, by id: what one round of enrichment
    adds. ``embed`` is a function of a column of text (name and description), any model's."""
    bare = entities.filter(F.col("embedding").isNull() & F.col("merged_into").isNull() & F.col("canonical_name").isNotNull()).orderBy("entity_id").limit(most)
    return bare.select("entity_id", embed(F.concat_ws(" ", "canonical_name", "description")).alias("embedding"))
