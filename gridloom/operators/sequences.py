"""Operators on ordered rows: windows, runs, samples, numbering, belief filters."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import ship

#: Least mean of a window that is worth taking, and the lengths tried in turn.
WORTH, FIRST, LATER = 1e-4, (5, 2, 2), (1, 1, 1)


def best_window(df: DataFrame, key: str, order: str, value: str, length: int) -> DataFrame:
    """(key, last_<order>, mean) of the full window with the greatest mean; ties to the earliest."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-(length - 1), 0)
    rows = df.select(key, order, F.avg(value).over(w).alias("m"), F.count(F.lit(1)).over(w).alias("n")).where(F.col("n") == length)
    best = rows.groupBy(key).agg(F.max(F.struct("m", (-F.col(order)).alias("neg"))).alias("b"))
    return best.where(F.col("b.m") > WORTH).select(key, (-F.col("b.neg")).alias(f"last_{order}"), F.col("b.m").alias("mean"))


def schedule_of(values: np.ndarray) -> list[tuple[int, int]]:
    """(place, round) of the values chosen: the best windows in turn, each taken out before the next; gaps close."""
    left, out = list(range(len(values))), []
    for turn, length in enumerate((*FIRST, *LATER)):
        if turn == len(FIRST) and len(out) >= 5:
            break
        if len(left) < length:
            continue
        total = np.concatenate([[0.0], np.cumsum(values[left])])
        means = (total[length:] - total[:-length]) / length
        at = int(means.argmax())
        if means[at] > WORTH:
            out += [(left[i], turn) for i in range(at, at + length)]
            del left[at : at + length]
    return out


def schedule(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows chosen by schedule_of, key by key; an agent's keyframe costs are a small group by nature."""
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def chosen(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        rows = schedule_of(pdf[value].to_numpy(float))
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(rows), order: [int(pdf[order].iloc[i]) for i, _ in rows], "turn": [t for _, t in rows]})

    return df.select(key, order, value).groupBy(key).applyInPandas(chosen, f"{key} {kind}, {order} long, turn int")


def belief_of(likelihood: np.ndarray, stay: float = 0.95, threshold: float = 0.6) -> tuple[np.ndarray, np.ndarray]:
    """Two-state recursive belief; the evidence is the greatest of two places before and three after. Flags that stand alone go."""
    n = len(likelihood)
    belief, now = np.zeros(n), 0.5
    for i in range(n):
        seen = likelihood[max(0, i - 2) : i + 4].max()
        prior = stay * now + (1 - stay) * (1 - now)
        now = prior * seen / max(1e-12, prior * seen + (1 - prior) * (1 - seen))
        belief[i] = now
    flag = belief > threshold
    near = np.concatenate([[False], flag[:-1]]) | np.concatenate([flag[1:], [False]])
    return belief, flag & near


def belief(df: DataFrame, key: str, order: str, likelihood: str) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b, f = belief_of(pdf[likelihood].to_numpy(float))
        return pd.DataFrame({key: pdf[key], order: pdf[order], "belief": b, "flag": f})

    return df.select(key, order, likelihood).groupBy(key).applyInPandas(filtered, f"{key} {kind}, {order} long, belief double, flag boolean")


def forward_fill(df: DataFrame, key: str, order: str, column: str) -> DataFrame:
    return df.withColumn(column, F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order)))


def reindex(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Numbers from 0 without gaps, by key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def strided(df: DataFrame, key: str, seq: str, about: int) -> DataFrame:
    """Every k-th row of a key (seq from 1), so that about so many remain."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("__n", n).where((F.col(seq) - 1) % F.greatest(F.floor(F.col("__n") / about), F.lit(1)) == 0).drop("__n")


def evenly(df: DataFrame, key: str, seq: str, parts: int) -> DataFrame:
    """The first row of each of so many equal parts of a key's rows (seq from 1)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    part = lambda s: F.floor((F.col(seq) - s) * float(parts) / F.col("__n"))
    return df.withColumn("__n", n).where((part(1) > part(2)) | (F.col(seq) == 1)).drop("__n")


def islands(df: DataFrame, key: str, seq: str) -> DataFrame:
    """Unbroken runs of seq."""
    run = F.col(seq) - F.row_number().over(Window.partitionBy(key).orderBy(seq))
    return df.select(key, seq, run.alias("__run")).groupBy(key, "__run").agg(F.min(seq).alias(f"first_{seq}"), F.max(seq).alias(f"last_{seq}"), F.count(F.lit(1)).alias("n")).drop("__run")


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Global numbers from 0 in order, without one task for all rows: ranges are sorted apart and numbered from the counts of those before."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order)
    spread = spread.withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(*order)
    spread = spread.withColumn("__row", F.row_number().over(inside))
    counts = spread.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    # One row for each range.
    before = counts.alias("a").join(counts.alias("b"), F.col("b.__part") < F.col("a.__part"), "left").groupBy(F.col("a.__part").alias("__part")).agg(F.coalesce(F.sum("b.__n"), F.lit(0)).alias("__before"))
    return spread.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__row") - 1).cast("long")).drop("__part", "__row", "__before")


