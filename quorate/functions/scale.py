"""Plan helpers that keep hot keys and large sides from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A side is broadcast only below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 * 1024 * 1024
# Only tables up to this size are dealt out to more tasks than they have splits.
SPREAD_BYTES = 256 * 1024 * 1024


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row's values take."""
    size = F.lit(0)
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind == "string":
            taken = F.octet_length(field.name)
        elif kind in ("array", "map", "struct"):
            taken = F.octet_length(F.to_json(F.struct(field.name)))
        else:
            taken = F.lit(8)
        size = size + F.coalesce(taken, F.lit(0))
    return size.cast("bigint")


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                   max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table is small enough to broadcast (reads ``max_rows`` rows at most)."""
    rows, size = (
        df.select(row_bytes(df).alias("b")).limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("b"), F.lit(0))).first()
    )
    return rows <= max_rows and size <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS,
                       max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only for a table of checked size.

    Beyond the bounds the frame is returned without hint, and Spark joins by
    shuffle with its skew handling.
    """
    return F.broadcast(df) if fits_broadcast(df, max_rows, max_bytes) else df


def spread(df: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """Deal out a small input with fewer splits than cores before CPU-heavy work.

    A table in one or two small files would otherwise be read, and its text cut
    into words, by one or two tasks. A table above ``max_bytes``, by Spark's own
    estimate, is never shuffled, however many cores there are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > max_bytes or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add costly columns so that each is evaluated once per row.

    The optimizer copies a projected expression into every later use and into
    filters below it; it does not reach through a generator of one row.
    """
    row = F.struct(*[col.alias(name) for name, col in columns.items()])
    return df.select("*", F.inline(F.array(row)))


def carry(df: DataFrame, keys: Sequence[str], seq: str, value: Column, out: str,
          block: int, forward: bool = True, inclusive: bool = True) -> DataFrame:
    """Nearest non-null ``value`` at or before each row (after it: ``forward=False``).

    Same result as ``last(value, ignorenulls)`` over the whole ordered group,
    but the group is cut into blocks of ``block`` units of the integer ``seq``:
    one grouped aggregate finds the value each block hands on, a window over
    those few block rows carries it across, and only the inside of a block is
    sorted together. A hot key is thus spread over as many tasks as it has
    blocks. ``seq`` must be unique within the keys; ``value`` must not be null
    inside a struct. ``inclusive=False`` leaves the row itself out.
    """
    pick = F.max_by if forward else F.min_by
    # One struct names a block of a group: it is never null, whatever its keys are,
    # so aggregate, window and join all share the one shuffle by it.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    number = F.floor(F.col(seq) / F.lit(block))
    cut = df.withColumns({
        "_value": value, "_cell": F.struct(key.alias("key"), number.alias("block"))})
    handed = cut.groupBy("_cell").agg(
        pick("_value", F.when(F.col("_value").isNotNull(), F.col(seq))).alias("_edge")
    )
    block_order = F.col("_cell.block") if forward else F.col("_cell.block").desc()
    row_order = F.col(seq) if forward else F.col(seq).desc()
    earlier = (
        Window.partitionBy("_cell.key").orderBy(block_order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = (
        Window.partitionBy("_cell").orderBy(row_order)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    carried = handed.select(
        "_cell", F.last("_edge", ignorenulls=True).over(earlier).alias("_carried")
    )
    return (
        cut.withColumn("_near", F.last("_value", ignorenulls=True).over(inside))
        .join(carried, "_cell")
        .withColumn(out, F.coalesce("_near", "_carried"))
        .drop("_cell", "_value", "_near", "_carried")
    )


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    fractions: Sequence[float], width: int = 1000) -> DataFrame:
    """Exact nearest-rank quantiles of an integer column, without sorting a group.

    The q-quantile is the smallest value whose running count reaches ``q * n``.
    First the counts of coarse bins of ``width`` units locate the bin each
    quantile falls into; then only the values of those bins are counted. Both
    windows run over counts, never over rows.
    """
    group = list(group)
    binned = df.where(F.col(value).isNotNull()).withColumn(
        "_bin", F.floor(F.col(value) / F.lit(width))
    )
    counts = binned.groupBy(*group, "_bin", value).agg(F.count(F.lit(1)).alias("_n"))
    bins = counts.groupBy(*group, "_bin").agg(F.sum("_n").alias("_bin_n"))
    by_bin = Window.partitionBy(*group).orderBy("_bin")
    so_far = by_bin.rowsBetween(Window.unboundedPreceding, 0)
    ranked = (
        bins.withColumn("_upto", F.sum("_bin_n").over(so_far))
        .withColumn("_total", F.sum("_bin_n").over(Window.partitionBy(*group)))
        .withColumn("_before", F.col("_upto") - F.col("_bin_n"))
        .withColumn("q", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
        .withColumn("_rank", F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("_total"))))
        .where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto")))
        .select(*group, "_bin", "q", "_rank", "_before", F.col("_total").alias("n"))
    )
    by_value = (
        Window.partitionBy(*group, "q").orderBy(value)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        counts.join(ranked, [*group, "_bin"])
        .withColumn("_upto", F.col("_before") + F.sum("_n").over(by_value))
        .where(F.col("_upto") >= F.col("_rank"))
        .groupBy(*group, "q")
        .agg(F.min(value).alias("quantile"), F.first("n").alias("n"))
    )
