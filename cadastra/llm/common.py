"""What several operators share: tables, durable cuts, ranks without a single task, components."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cadastra.session import durable, release  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    """Partitions of a shuffle as the deployment sized them for its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def renamed(df: DataFrame, columns: Sequence[str], prefix: str = "in_") -> DataFrame:
    """Only ``columns`` of ``df``, under prefixed names, so that no other column of any name is in the way."""
    return df.select(*(df[f"`{c}`"].alias(prefix + c) for c in columns))


def ranked(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str, salts: int) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each ``key``, in no particular order, never a whole key in one task.

    A key's rows are dealt to ``salts`` sub-groups by a hash of ``order``; rows are numbered inside a
    sub-group and shifted by the sizes of those before it. Rows equal in all of ``order`` share a
    sub-group and are interchangeable. ``df`` is read twice and must be durable.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*key, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *(F.col(c).alias(f"_k{i}") for i, c in enumerate(key)),
        F.col("_salt").alias("_s"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    within = Window.partitionBy(*key, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(within) - 1)
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)] + [F.col("_salt") == F.col("_s")]
    on = same[0]
    for x in same[1:]:
        on = on & x
    out = numbered.join(shifts, on).withColumn(name, F.col("_row").cast("long") + F.col("_shift"))
    return out.select(*df.columns, name)


ROWS_A_TASK = 100_000  # of a few numbers each


def compact(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than ``rows`` short rows are worth, without a shuffle."""
    return df.coalesce(max(1, -(-rows // ROWS_A_TASK)))


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """Connected components of undirected ``edges``: (node, component), component the smallest node reached.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until every node but the roots points
    at one root; each is one group-by on the centre's minimum and one join. Every step is durable, and hub
    nodes are split because the minimum is pre-aggregated and both sides of a join have exchanges of
    their own, which may be dealt anew. Nodes without an edge don't occur.
    """
    kept = links = durable(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    for _ in range(limit):
        n = links.count()
        links = compact(links, n)
        ends = links.select(F.col("u").alias("n"), F.lit(1).alias("child"), F.lit(0).alias("root")).union(links.select("v", F.lit(0), F.lit(1)))
        state = compact(ends.groupBy("n").agg(F.sum("child").alias("child"), F.max("root").alias("root")), 2 * n)
        if state.where((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("root") == 1))).isEmpty():
            break
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(compact(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * n))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        down = durable(compact(large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), n))
        release(kept, least)
        least = durable(compact(down.groupBy("u").agg(F.min("v").alias("m")), n))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = links = durable(compact(small.union(least.select("u", "m")).distinct(), n))
        release(down, least)
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` (of each node the least of its component) after the links (i, j)."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def arrow_rows(df: DataFrame, make, schema: T.StructType | str) -> DataFrame:
    """``df`` through ``make``: an iterator of record batches to an iterator of dicts of columns."""
    fields = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in make(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in kinds], schema=kinds)

    return df.mapInArrow(run, fields)


def utf8_length(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
