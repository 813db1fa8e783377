"""Running totals and gaps over keys of any size, in two levels.

The rows of a key are parted by a bucket that never falls in their order.  Each bucket is summed up first, a window over
these sums, one row a bucket, says what lies before each, and that goes in front of the bucket's rows, as one row more, for a window
within (key, bucket).  So no task sorts all rows of a hot key, rows are dealt once, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

_FOLD = {"sum": F.sum, "max": F.max, "min": F.min, "count": F.sum}


def running(rows: DataFrame, keys: list[str], bucket: Column, order: list[str | Column], values: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Adds to each row, by name, the fold (sum, max, min or count) of a column over its key's rows up to it.

    Without ``inclusive`` the row itself is left out; nothing before it gives null, or a count of 0.  Null keys are keys like others, and a null
    bucket comes first.
    """
    cols = {f"__v_{n}": F.when(v.isNotNull(), F.lit(1).cast("long")) if f == "count" else v for n, (f, v) in values.items()}
    b = rows.withColumns({"__bucket": bucket, "__row": F.lit(1), **cols})
    each = b.groupBy(*keys, "__bucket").agg(*[_FOLD[f](f"__v_{n}").alias(f"__t_{n}") for n, (f, _) in values.items()])
    ahead = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    each = each.select(*keys, "__bucket", F.lit(0).alias("__row"), *[_FOLD[f](f"__t_{n}").over(ahead).alias(f"__v_{n}") for n, (f, _) in values.items()])
    within = Window.partitionBy(*keys, "__bucket").orderBy("__row", *order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    none = lambda f: [F.lit(0).cast("long")] if f == "count" else []
    out = b.unionByName(each, allowMissingColumns=True).withColumns({n: F.coalesce(_FOLD[f](f"__v_{n}").over(within), *none(f)) for n, (f, _) in values.items()})
    return out.where("__row = 1").drop("__bucket", "__row", *cols)


def parted(rows: DataFrame, keys: list[str], start: Column, end: Column, margin: float, name: str, span: float = 1024.0) -> DataFrame:
    """Adds ``name``, the same for rows of a key whose intervals hang together: more than ``margin`` lies between parts.

    A part is named by its first start.  Rows without a start fall in the first part.
    """
    b = rows.withColumns({"__start": start.cast("double"), "__end": end.cast("double")})
    bucket, order = F.floor(F.col("__start") / span), [F.col("__start").asc_nulls_first()]
    b = running(b, keys, bucket, order, {"__reach": ("max", F.col("__end"))}, inclusive=False)
    first = F.when(F.col("__reach").isNull() | (F.col("__start") > F.col("__reach") + margin), F.col("__start"))
    # of rows with one start, that which begins a part comes first
    b = b.withColumn("__first", first)
    b = running(b, keys, bucket, [*order, F.col("__first").asc_nulls_last()], {name: ("max", F.col("__first"))})
    return b.drop("__start", "__end", "__reach", "__first")
