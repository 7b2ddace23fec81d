"""The lag self-join: rows of a series paired with later rows of the same series.

Steps are split into chunks of half the longest lag. Origins stay in their chunk and partners are given
to their own chunk and the two before, so all pairs of an origin meet under the key (series, remainder
by the stride, chunk): an equi-join whose keys number series x chunks whatever the lag count. The
shuffle carries four times the series, not a row for each lag; pairs go straight into the partial
aggregation. Two thirds of the candidates under a key are pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks that the longest lag spans.
PARTS = 2


def lag_pairs(origins: DataFrame, partners: DataFrame, stride: int, first: int, count: int, keys: Sequence[str] = ("traj_id", "atom_idx")) -> DataFrame:
    """Pairs with first <= k < first + count, partner step = origin step + k * stride; columns of both and ``k``.

    Both have ``step`` and ``keys``; other column names must differ. No lags give no rows.
    """
    last = first + count - 1
    if count <= 0:
        last, first = 0, 1
    width = max(-(-last // PARTS), 1)
    u, r = F.floor(F.col("step") / F.lit(stride)), F.col("step") % F.lit(stride)
    o = origins.withColumns({"__r": r, "__u": u}).withColumn("__chunk", F.floor(F.col("__u") / F.lit(width)))
    p = partners.withColumns({"__r": r, "__v": u}).drop("step").withColumn("__own", F.floor(F.col("__v") / F.lit(width)))
    p = p.withColumn("__chunk", F.explode(F.array(*[F.col("__own") - i for i in range(PARTS + 1)]))).drop("__own")
    k = F.col("__v") - F.col("__u")
    met = o.join(p, [*keys, "__r", "__chunk"]).where((k >= first) & (k <= last))
    return met.withColumn("k", k.cast("int")).drop("__r", "__u", "__v", "__chunk")
