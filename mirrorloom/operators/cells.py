"""Forests over many rows with few different features: every tree's draws are summed by cell (rows with the same binned features), then each tree is fitted to its sums."""

from __future__ import annotations

import math
import random
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoderModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..written import discard, written
from .profile import unpivot

#: The bins of a number, as many as a forest of pyspark.ml makes; up to twice as many different values all stay.
_BINS = 32
#: Trees that are fitted at the same time; each is a small job.
_AT_ONCE = 8


def edges(rows: DataFrame, columns: list[str]) -> list[list[float]]:
    """For each column the least values of its bins but the first: between all values where they are few, else at quantiles. A value that is a quantile twice has a bin of its own."""
    guess = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if guess[c] <= 2 * _BINS]
    many = [c for c in columns if c not in few]
    values: dict[str, set[float]] = {c: set() for c in few}
    for c, v in unpivot(rows, few).distinct().collect() if few else []:  # some 64 values a column
        values[c].add(float(v))
    steps: dict[str, set[float]] = {c: set() for c in columns}
    for c in few:
        own = sorted(values[c])
        steps[c] = {math.nextafter(m if a < (m := (a + b) / 2) < b else a, math.inf) for a, b in zip(own, own[1:])}
    for c, found in zip(many, rows.approxQuantile(many, [i / _BINS for i in range(1, _BINS)], 0.001) if many else []):
        steps[c] = {math.nextafter(q, math.inf) for q in found} | {a for a, b in zip(found, found[1:]) if a == b}
    return [sorted(x for x in steps[c] if math.isfinite(x)) for c in columns]


def poisson(mean: int):
    """The least number and the cumulated chances from it on, without tails under 1e-30."""
    import numpy as np

    spread = 12 * math.sqrt(mean) + 40
    low = max(0, int(mean - spread))
    steps = np.log(mean / np.arange(low + 1, int(mean + spread) + 1))
    chances = np.cumsum(np.exp(np.cumsum([low * math.log(mean) - mean - math.lgamma(low + 1), *steps])))
    return low, chances / chances[-1]


def draws(key, count, trees: int):
    """How often each tree draws the rows of a group, with replacement: a row for each key (count: its rows), a column for each tree. A key's numbers are its SplitMix64 sequence, so partitions don't matter."""
    import numpy as np

    z = key.astype(np.uint64)[:, None] + np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53
    order = np.argsort(count, kind="stable")
    means, starts = np.unique(count[order], return_index=True)
    out = np.empty(u.shape)
    for mean, at in zip(means.tolist(), np.split(order, starts[1:])):
        low, chances = poisson(mean)
        out[at] = low + np.searchsorted(chances, u[at], side="right")
    return out


def _summed(trees: int, cells: int):
    """For mapInPandas: cell, key, n, label to the sums of each cell, of the draws (w) and of the labels drawn (s) of every tree."""

    def add(batches):
        import numpy as np
        import pandas as pd

        total, seen = np.zeros((2, cells, trees)), np.zeros(cells, dtype=bool)
        for batch in batches:
            order = np.argsort(batch["cell"].to_numpy(), kind="stable")
            cell, key, n, label = (batch[c].to_numpy()[order] for c in ("cell", "key", "n", "label"))
            for i in range(0, len(cell), 1024):  # so that what is drawn stays in the processor's cache
                at = slice(i, i + 1024)
                found, starts = np.unique(cell[at], return_index=True)
                k = draws(key[at], n[at], trees)
                total[0, found] += np.add.reduceat(k, starts)
                total[1, found] += np.add.reduceat(k * label[at, None], starts)
                seen[found] = True
        at = np.flatnonzero(seen)
        yield pd.DataFrame(np.hstack([total[0, at], total[1, at]]), columns=_sums(trees)).assign(cell=at)

    return add


def _sums(trees: int) -> list[str]:
    return [f"{x}{t}" for x in "ws" for t in range(trees)]


def predicted(rows: DataFrame, test: DataFrame, features: PipelineModel, numeric: list[str], categorical: list[str], target: str, classes: bool, trees: int, seed: int, most: int) -> tuple[DataFrame, list[DataFrame]] | None:
    """test's label and prediction by a forest fitted to all of rows, and the written tables behind them; nothing if rows have more cells than ``most``.

    A tree draws each row a Poisson number of times, as forests of pyspark.ml do. A split's gain follows from the draws and labels
    summed by cell, so a tree of the sums is that of the rows. features: the fitted stages; their index of the labels is kept."""
    places = [s for s in features.stages if not isinstance(s, OneHotEncoderModel | VectorAssembler)]
    vectors = PipelineModel(stages=features.stages[len(places) :])
    known = PipelineModel(stages=places)
    inputs = [f"{c}_in" for c in numeric]
    keys = [*inputs, *[f"{c}_ix" for c in categorical]]
    bins = []
    if numeric:
        splits = [[-math.inf, *(own or [0.0]), math.inf] for own in edges(known.transform(rows), inputs)]
        bins = [Bucketizer(splitsArray=splits, inputCols=inputs, outputCols=[f"{c}_bin" for c in numeric])]

    def placed(df: DataFrame) -> DataFrame:
        # Adding 0 takes the bins' description as categories away: they are numbers.
        return PipelineModel(stages=[known, *bins]).transform(df).select(*[(F.col(f"{c}_bin") + 0.0).alias(f"{c}_in") for c in numeric], *[f"{c}_ix" for c in categorical], F.col("label" if classes else target).alias("label"))

    own = [*keys, "label"] if classes else keys
    different = written(placed(rows).select(own).distinct().limit(most + 1), "cells")
    cells = different.count()
    if cells > most:
        discard(different)
        return None
    numbered = different.withColumn("cell", F.row_number().over(Window.orderBy(*own)) - 1)  # at most ``most`` rows
    groups = placed(rows).join(F.broadcast(numbered), own).groupBy("cell", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = groups.select("cell", F.xxhash64(F.lit(seed), "cell", "label").alias("key"), "n", "label")
    sums = groups.mapInPandas(_summed(trees, cells), "cell int, " + ", ".join(f"{c} double" for c in _sums(trees))).groupBy("cell").agg(*[F.sum(c).alias(c) for c in _sums(trees)])
    # One file of ``most`` rows at most, as every tree reads its two columns.
    bags = written(vectors.transform(numbered.drop("label")).select("cell", "features").join(sums, "cell").drop("cell").repartition(1), "bags")
    models = _fitted(bags, placed(rows).schema["label"].metadata, classes, trees, seed)
    asked = written(placed(test).select(keys).distinct(), "asked")
    guessed = vectors.transform(asked)
    for m in models:
        guessed = m.transform(guessed)
    if classes:
        votes = [vector_to_array(m.getProbabilityCol()) for m in models]
        share = F.array(*[sum((v[i] for v in votes), F.lit(0.0)) for i in range(models[0].numClasses)])
        guess = (F.array_position(share, F.array_max(share)) - 1).cast("double")
    else:
        guess = sum((F.col(m.getPredictionCol()) for m in models), F.lit(0.0)) / trees
    guesses = written(guessed.select(*keys, guess.alias("prediction")), "guesses")
    return placed(test).join(guesses, keys).select(F.col("label").alias("label" if classes else target), "prediction"), [different, bags, asked, guesses]


def _fitted(bags: DataFrame, label: dict, classes: bool, trees: int, seed: int) -> list:
    """A tree for each bag, fitted to the cells with the draws as weights and the mean of the labels drawn."""
    own = {"rawPredictionCol": "", "predictionCol": ""} if classes else {}
    kind, some, out = (RandomForestClassifier, "sqrt", "probabilityCol") if classes else (RandomForestRegressor, "onethird", "predictionCol")
    seeds = random.Random(seed)
    forests = [kind(numTrees=1, bootstrap=False, featureSubsetStrategy=some, weightCol="w", seed=seeds.getrandbits(62), **own, **{out: f"tree{t}"}) for t in range(trees)]

    def fit(t: int):
        w = F.col(f"w{t}")
        return forests[t].fit(bags.filter(w > 0).select("features", w.alias("w"), (F.col(f"s{t}") / w).alias("label", metadata=label)))

    with ThreadPool(min(_AT_ONCE, trees)) as pool:
        return pool.map(inheritable_thread_target(bags.sparkSession)(fit), range(trees), chunksize=1)
