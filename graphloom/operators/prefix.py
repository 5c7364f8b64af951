"""Running sums over a whole table or inside groups of any size, without a window over more than one range partition.

Rows are dealt by ranges of (group, order) and written with the number of their partition; each partition sums up its own
rows, and the sums of the partitions before it are added.  A group that holds most rows spreads over as many partitions as
its rows need; what meets in one task is a row for each partition (and group) only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cut import cut


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    on = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        on = on & left[k].eqNullSafe(right[k])
    return on


def prefix_sums(df: DataFrame, sums: Mapping[str, str], order: Sequence[Column | str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` with a column for each of ``sums`` (new name -> expression that isn't null): its sum over the rows of the same
    ``by`` up to and with this one, in ``order``.  Rows that tie in the order are taken in any sequence.  Null is a group
    like any other; an empty table gives no rows."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = cut(df.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_part", F.spark_partition_id()))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumns({name: F.sum(F.expr(e)).over(inside) for name, e in sums.items()})
    total = dealt.groupBy("_part", *by).agg(*[F.sum(F.expr(e)).alias(f"_{name}") for name, e in sums.items()])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    total = total.withColumns({f"_{name}": F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)) for name in sums})
    joined = own.join(total, _same(own, total, ["_part", *by]))
    return joined.select(*[own[c] for c in df.columns], *[(own[name] + total[f"_{name}"]).alias(name) for name in sums])
