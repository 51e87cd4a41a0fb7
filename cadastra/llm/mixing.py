"""Mixing sources to target weights by Poisson replication.

A document of a source with rate r (its target share of the mix, in documents, over its own number)
occurs Poisson(r) times. The draw inverts the distribution at a uniform number made of a hash of the
document and the seed, so it depends on nothing else. Each document is exploded by its count and the
copies are dealt in an order given by another hash. DataFrame functions only.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rates above this are drawn as a sum of equal parts, so that exp(-rate) stays a normal number.
LARGEST_RATE = 64.0
UNIFORM_BITS = 52

#: Relative weights of the mix; sources not listed share OTHER in proportion to their sizes.
TARGET = {"src0": 0.15, "src1": 0.08, "src2": 0.08, "src3": 0.04, "src4": 0.04, "src5": 0.02}
OTHER = 0.59


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of ``parts``."""
    digest = F.md5(F.concat_ws("/", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, UNIFORM_BITS // 4), 16, 10).cast("long").cast("double") / F.lit(float(2**UNIFORM_BITS))


def terms_for(rate: float) -> int:
    """So many terms that what is beyond them is below 2**-60 of the whole."""
    return int(rate + 12 * math.sqrt(rate) + 30)


def poisson_cdf(rate: float) -> list[float]:
    term = math.exp(-rate)
    out = [term]
    for k in range(1, terms_for(rate)):
        term = term * rate / k
        out.append(out[-1] + term)
    return out


def inverted(us: Column, cdf: Column) -> Column:
    """The sum over ``us`` of the number of terms of ``cdf`` not above; a u's hash isn't taken again for each term."""
    return F.aggregate(F.transform(us, lambda u: F.size(F.filter(cdf, lambda c: c <= u))), F.lit(0), lambda x, y: x + y)


def rates(counts: Mapping[str | None, int], target: Mapping[str, float], other: float, total: int) -> dict[str | None, float]:
    """Mean copies of a document by bucket; None is the bucket of sources that ``target`` doesn't list.

    Weights of buckets without documents go to the others in proportion.
    """
    weight = {b: (other if b is None else target[b]) for b, n in counts.items() if n}
    whole = sum(weight.values())
    return {b: w / whole * total / counts[b] if whole else 0.0 for b, w in weight.items()}


def mix(df: DataFrame, target: Mapping[str, float] = TARGET, other: float = OTHER, seed: str = "mix-1", size: float = 1.0, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """All columns of ``df``, each row as often as drawn, with copy (int, from 0) and copies (int), in mixed order.

    The mix has ``size`` times the rows of ``df`` in the mean, and bucket b its target share of them.
    A null source belongs to the unlisted. Rows with equal ids have equal draws; a null id draws as an
    id of its own kind. Columns named copy or copies are replaced. Every row takes part; a rate below
    one leaves rows out by the draw alone.
    """
    df = df.drop("copy", "copies")
    source = F.col(f"`{source_column}`")
    bucket = F.when(source.isin(*target), source) if target else F.lit(None).cast("string")
    counted = df.groupBy(bucket.alias("b")).count().collect()  # one row for each listed source and one more
    counts = {b: int(n) for b, n in counted}
    rate = rates(counts, target, other, round(size * sum(counts.values())))
    if not rate:
        return df.select("*", F.lit(0).alias("copy"), F.lit(0).alias("copies"))
    draws = {b: max(1, math.ceil(r / LARGEST_RATE)) for b, r in rate.items()}
    key = F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null"))
    count = F.lit(0)
    for b, r in rate.items():
        us = F.array(*(uniform(F.lit(seed), F.lit(str(i)), key) for i in range(draws[b])))
        drawn = inverted(us, F.array(*map(F.lit, poisson_cdf(r / draws[b]))))
        count = F.when(bucket.eqNullSafe(F.lit(b)), drawn).otherwise(count)
    copies = df.withColumn("copies", count.cast("int")).where("copies > 0")
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    return copies.select(*df.columns, "copy", "copies")


def shuffled(df: DataFrame, seed: str = "mix-1", id_column: str = "doc_id") -> DataFrame:
    """``df`` in an order that a hash of the seed, id and copy gives, over all partitions."""
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_column}`").cast("string"), F.lit("null")), F.col("copy"))
    return df.withColumn("_at", key).repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")
