"""Sparse convolution and pooling as joins: sites are rows, filters are offset tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.voxels import shifted


def input_layer(points: DataFrame, keys: Sequence[str], order: str, features: Sequence[str], mode: str) -> DataFrame:
    """One row for each site: the first or last row by order, the sum or the mean of the features."""
    of = {"first": lambda c: F.min_by(c, order), "last": lambda c: F.max_by(c, order), "sum": F.sum, "mean": F.avg}[mode]
    return points.groupBy(*keys).agg(*[of(c).alias(c) for c in features])


def window_offsets(size: Sequence[int]) -> list[tuple[int, ...]]:
    """Offsets of a filter around its site, from -size // 2, last axis fastest."""
    out: list[tuple[int, ...]] = [()]
    for n in size:
        out = [(*o, i - n // 2) for o in out for i in range(n)]
    return out


def rules(sites: DataFrame, keys: Sequence[str], size: Sequence[int]) -> DataFrame:
    """(keys of the output site, offset number, in_<key>) for a filter whose output sites are the input's."""
    moved = shifted(sites.select(*keys, *[F.col(k).alias(f"in_{k}") for k in keys]), keys, [tuple(-x for x in o) for o in window_offsets(size)])
    return moved.join(sites.select(*keys), list(keys), "left_semi")


def _applied(pairs: DataFrame, keys: Sequence[str], features: Sequence[str], weights: Sequence[Sequence[Sequence[float]]], bias: Sequence[float]) -> DataFrame:
    """Sum over offsets of the weight matrix times the features, and the bias: gather, multiply, scatter-add."""
    outs = len(bias)
    table = F.array(*[F.array(*[F.array(*[F.lit(float(w[i][o])) for i in range(len(features))]) for o in range(outs)]) for w in weights])
    terms = [sum((F.col(f) * table[F.col("offset")][o][i] for i, f in enumerate(features)), F.lit(0.0)) for o in range(outs)]
    return pairs.groupBy(*keys).agg(*[(F.sum(t) + F.lit(float(b))).alias(f"y{o}") for o, (t, b) in enumerate(zip(terms, bias, strict=True))])


def submanifold(sites: DataFrame, keys: Sequence[str], features: Sequence[str], size: Sequence[int], weights, bias) -> DataFrame:
    """Convolution whose output sites are its input sites."""
    moved = shifted(sites.select(*keys, *features), keys, [tuple(-x for x in o) for o in window_offsets(size)])
    return _applied(moved.join(sites.select(*keys), list(keys), "left_semi"), keys, features, weights, bias)


def strided_sites(sites: DataFrame, keys: Sequence[str], size: int, stride: int, extent: int) -> DataFrame:
    """Each site at every output site whose window holds it, with its place in the window as offset, last axis fastest."""
    out = sites
    for k in keys:
        low = F.greatest(F.floor((F.col(k) - size + stride) / stride), F.lit(0))
        high = F.least(F.lit((extent - size) // stride), F.floor(F.col(k) / stride))
        out = out.withColumn(f"__o{k}", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    place = F.lit(0)
    for k in keys:
        place = place * size + (F.col(k) - F.col(f"__o{k}") * stride)
    return out.withColumn("offset", place.cast("int")).drop(*keys).withColumnsRenamed({f"__o{k}": k for k in keys})


def extent_of(sites: DataFrame, keys: Sequence[str], size: int, stride: int) -> int:
    """The least extent, in whole strides, whose windows hold all sites; keys are 0 or more."""
    top = sites.agg(*[F.max(k) for k in keys]).first()
    last = max((x for x in top if x is not None), default=0)
    return size + max(0, -(-(last + 1 - size) // stride)) * stride


def strided(sites: DataFrame, keys: Sequence[str], features: Sequence[str], size: int, stride: int, extent: int, weights, bias) -> DataFrame:
    return _applied(strided_sites(sites, keys, size, stride, extent), keys, features, weights, bias)


def transposed(outputs: DataFrame, inputs: DataFrame, keys: Sequence[str], features: Sequence[str], size: int, stride: int, extent: int, weights, bias) -> DataFrame:
    """Deconvolution back to the given input sites, by the same rules read the other way."""
    ways = strided_sites(inputs.select(*keys, *[F.col(k).alias(f"to_{k}") for k in keys]), keys, size, stride, extent)
    pairs = ways.join(outputs, list(keys)).drop(*keys).withColumnsRenamed({f"to_{k}": k for k in keys})
    return _applied(pairs, keys, features, weights, bias)


def pool(sites: DataFrame, keys: Sequence[str], features: Sequence[str], stride: int, mode: str) -> DataFrame:
    """Maximum, mean over the window's volume, or mean over active sites, by coarse site."""
    coarse = [F.floor(F.col(k) / stride).cast("long").alias(k) for k in keys]
    of = {"max": F.max, "active": F.avg, "average": lambda c: F.sum(c) / float(stride ** len(keys))}[mode]
    return sites.select(*coarse, *features).groupBy(*keys).agg(*[of(c).alias(c) for c in features])


def unpool(coarse: DataFrame, sites: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """Each site with the features of its coarse site."""
    cells = [F.floor(F.col(k) / stride).cast("long").alias(f"__c{k}") for k in keys]
    renamed = coarse.withColumnsRenamed({k: f"__c{k}" for k in keys})
    return sites.select(*keys, *cells).join(renamed, [f"__c{k}" for k in keys]).drop(*[f"__c{k}" for k in keys])


def batch_norm(sites: DataFrame, features: Sequence[str], epsilon: float = 1e-4, leak: float | None = None) -> DataFrame:
    """Features by their mean and variance over all sites (one row), with a leaky rectifier if one is given."""
    stats = sites.agg(*[F.avg(c).alias(f"__m{c}") for c in features], *[F.var_pop(c).alias(f"__v{c}") for c in features])
    out = sites.join(F.broadcast(stats))
    for c in features:
        y = (F.col(c) - F.col(f"__m{c}")) / F.sqrt(F.col(f"__v{c}") + epsilon)
        out = out.withColumn(c, leaky(y, leak) if leak is not None else y)
    return out.drop(*stats.columns)


def leaky(x: Column, leak: float) -> Column:
    return F.when(x > 0, x).otherwise(x * leak)


def linear(sites: DataFrame, features: Sequence[str], weights: Sequence[Sequence[float]], bias: Sequence[float]) -> DataFrame:
    """Network in network: the same linear map at every site."""
    rest = [c for c in sites.columns if c not in features]
    return sites.select(*rest, *[(sum((F.col(f) * float(w[o]) for f, w in zip(features, weights, strict=True)), F.lit(0.0)) + float(b)).alias(f"y{o}") for o, b in enumerate(bias)])


def unet(sites: DataFrame, keys: Sequence[str], features: Sequence[str], depth: int, extent: int, params) -> DataFrame:
    """Encoder and decoder over strided levels with skip connections.

    params(name, ins, outs, taps) gives (weights, bias) of a layer; level l has twice the
    features of the one above. Each level is a chain of joins; callers cut the lineage
    of deep networks with checkpoint().
    """
    n = len(features)
    w, b = params(f"pre{depth}", n, n, 3 ** len(keys))
    here = submanifold(sites, keys, features, [3] * len(keys), w, b).withColumnsRenamed({f"y{i}": f for i, f in enumerate(features)})
    for f in features:
        here = here.withColumn(f, leaky(F.col(f), 0.0))
    if depth <= 1:
        return here
    deep = [f"{features[0]}_{depth}_{i}" for i in range(2 * n)]
    w, b = params(f"down{depth}", n, 2 * n, 2 ** len(keys))
    down = strided(here, keys, features, 2, 2, extent, w, b).withColumnsRenamed({f"y{i}": f for i, f in enumerate(deep)})
    below = unet(down, keys, deep, depth - 1, extent // 2, params)
    w, b = params(f"up{depth}", 2 * n, n, 2 ** len(keys))
    up = transposed(below, here, keys, deep, 2, 2, extent, w, b)
    # Sites beyond the last full window have nothing from below.
    joined = here.join(up, list(keys), "left").fillna(0.0, [f"y{i}" for i in range(n)])
    w, b = params(f"post{depth}", 2 * n, n, 1)
    return linear(joined, [*features, *[f"y{i}" for i in range(n)]], w[0], b).withColumnsRenamed({f"y{i}": f for i, f in enumerate(features)})
