"""Comparisons of an original table and its look-alike: overlap, distance, similarity, quality."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..written import discard, written
from .profile import number, unpivot
from .relate import pearson, running


def _text(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in cols])


def risk_level(rate, high: float, medium: float):
    return F.when(rate > high, "high").when(rate > medium, "medium").otherwise("low")


def exact_overlap(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """One row: distinct synthetic rows, those also in the original, rate, risk. Over all rows, nulls as empty text."""
    a, b = _text(original, cols).distinct(), _text(synthetic, cols).distinct()
    tagged = b.join(a.withColumn("hit_", F.lit(1)), cols, "left")
    one = tagged.agg(F.count("*").alias("rows"), F.count("hit_").alias("shared"))
    rate = F.when(F.col("rows") > 0, F.col("shared") / F.col("rows")).otherwise(0.0)
    return one.select("rows", "shared", rate.alias("rate"), risk_level(rate, 0.1, 0.05).alias("risk"))


def rare_combinations(original: DataFrame, synthetic: DataFrame, a: str, b: str, most: int = 3) -> DataFrame:
    """One row: the original's combinations of at most ``most`` rows, how many the synthetic has too, rate, risk. Nulls are no group."""
    rare = original.select(a, b).dropna().groupBy(a, b).count().filter(F.col("count") <= most)
    there = synthetic.select(a, b).dropna().distinct().withColumn("hit_", F.lit(1))
    one = rare.join(there, [a, b], "left").agg(F.count("*").alias("rare"), F.count("hit_").alias("preserved"))
    rate = F.when(F.col("rare") > 0, F.col("preserved") / F.col("rare")).otherwise(0.0)
    return one.select("rare", "preserved", rate.alias("rate"), risk_level(rate, 0.5, 0.2).alias("risk"))


def linkage(original: DataFrame, synthetic: DataFrame, keys: list[str]) -> DataFrame:
    """One row: groups of the original, groups of one row in the synthetic, rate, risk."""
    groups = original.select(*keys).dropna().distinct().agg(F.count("*").alias("groups"))
    single = synthetic.select(*keys).dropna().groupBy(*keys).count().agg(F.count_if(F.col("count") == 1).alias("single"))
    rate = F.when(F.col("groups") > 0, F.col("single") / F.col("groups")).otherwise(0.0)
    return groups.crossJoin(F.broadcast(single)).select("groups", "single", rate.alias("rate"), risk_level(rate, 0.3, 0.1).alias("risk"))


def uniqueness(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """column, original and synthetic distinct values, ratio."""
    count = lambda df, to: unpivot(df, cols).dropna().distinct().groupBy("column").agg(F.count("*").alias(to))
    j = count(original, "original").join(count(synthetic, "synthetic"), "column", "full_outer")
    o, s = F.coalesce("original", F.lit(0)), F.coalesce("synthetic", F.lit(0))
    return j.select("column", o.alias("original"), s.alias("synthetic"), F.when(o > 0, s / o).otherwise(0.0).alias("ratio"))


def unseen_categories(df: DataFrame, reference: DataFrame, col: str) -> DataFrame:
    """Rows whose value of col isn't among the reference's (null equals null)."""
    known = reference.select(F.col(col).alias("known_")).distinct()
    return df.join(known, F.col(col).eqNullSafe(F.col("known_")), "left_anti")


def aligned_frequencies(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """column, value, p, q: the shares of a value on both sides, 0 where it is missing; null is the value 'nan'."""

    def shares(df: DataFrame, to: str) -> DataFrame:
        counts = unpivot(df, cols).select("column", F.coalesce("value", F.lit("nan")).alias("value")).groupBy("column", "value").agg(F.count("*").alias("n_"))
        total = counts.groupBy("column").agg(F.sum("n_").alias("t_"))
        return counts.join(F.broadcast(total), "column").select("column", "value", (F.col("n_") / F.col("t_")).alias(to), F.col("n_").alias(f"{to}_n"))

    j = shares(original, "p").join(shares(synthetic, "q"), ["column", "value"], "full_outer")
    return j.select("column", "value", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("p", "q", "p_n", "q_n")])


def categorical_similarity(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """column, js (Jensen-Shannon, nats), tv (total variation), chi2, score (1 - js)."""
    f = aligned_frequencies(original, synthetic, cols)
    floor = f.select("column", "value", "p", "q", "p_n", "q_n", F.greatest("p", F.lit(1e-10)).alias("a"), F.greatest("q", F.lit(1e-10)).alias("b"))
    t = floor.groupBy("column").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum("q_n").alias("tq"))
    j = floor.join(F.broadcast(t), "column").withColumn("a", F.col("a") / F.col("ta")).withColumn("b", F.col("b") / F.col("tb"))
    m = (F.col("a") + F.col("b")) / 2
    js = 0.5 * F.sum(F.col("a") * F.log(F.col("a") / m)) + 0.5 * F.sum(F.col("b") * F.log(F.col("b") / m))
    expected = F.greatest(F.col("p"), F.lit(1e-10)) * F.col("tq")
    chi2 = F.sum((F.col("q_n") - expected) * (F.col("q_n") - expected) / expected)
    return j.groupBy("column").agg(js.alias("js"), (0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv"), chi2.alias("chi2"), (1 - js).alias("score"))


def ks_wasserstein(original: DataFrame, synthetic: DataFrame, col: str) -> DataFrame:
    """column, ks (greatest distance of the distribution functions), wasserstein. Only distinct values are sorted, in ranges."""
    x = number(col)
    side = lambda df, a, b: df.select(x.alias("x")).dropna().groupBy("x").agg(F.count("*").alias("n")).select("x", (F.col("n") * a).alias("na"), (F.col("n") * b).alias("nb"))
    counts = side(original, 1, 0).unionByName(side(synthetic, 0, 1)).groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    total = counts.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    both = running(counts, "x", ["na", "nb"]).crossJoin(F.broadcast(total))
    gap = F.abs((F.col("before_na") + F.col("na")) / F.col("ta") - (F.col("before_nb") + F.col("nb")) / F.col("tb"))
    width = F.coalesce(F.col("next_") - F.col("x"), F.lit(0.0))
    return both.agg(F.max(gap).alias("ks"), F.sum(gap * width).alias("wasserstein")).select(F.lit(col).alias("column"), "ks", "wasserstein")


def numeric_similarity(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """column, the relative differences of mean, std, median and skewness (at most 1), the Wasserstein distance over the original's range, and score.

    The score is the mean of 1 - the mean difference and 1 - that distance (at most 1).
    """
    from .profile import numeric_profile

    a, b = numeric_profile(original, cols), numeric_profile(synthetic, cols)
    named = ("mean", "std", "q50", "skewness")
    j = a.select("column", (F.col("max") - F.col("min")).alias("range"), *[F.col(c).alias(f"a_{c}") for c in named]).join(F.broadcast(b.select("column", *[F.col(c).alias(f"b_{c}") for c in named])), "column")
    apart = None
    for c in cols:
        own = ks_wasserstein(original, synthetic, c)
        apart = own if apart is None else apart.unionByName(own)
    j = j.join(F.broadcast(apart.select("column", "wasserstein")), "column", "left")
    x = lambda side, c: F.coalesce(F.col(f"{side}_{c}"), F.lit(0.0)) if c == "skewness" else F.col(f"{side}_{c}")
    diff = lambda c: F.least(F.lit(1.0), F.abs(x("a", c) - x("b", c)) / F.greatest(F.abs(x("a", c)), F.lit(1.0 if c == "skewness" else 1e-10)))
    d = [diff(c) for c in named]
    moved = F.least(F.lit(1.0), F.col("wasserstein") / F.greatest("range", F.lit(1e-10)))
    score = 0.5 * (1 - sum(d[1:], d[0]) / len(d)) + 0.5 * (1 - moved)
    return j.select("column", *[e.alias(f"{k}_diff") for k, e in zip(("mean", "std", "median", "skew"), d)], moved.alias("distance"), score.alias("score"))


def correlation_similarity(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """One row: similarity = 1 - min(1, Frobenius norm of the difference of the correlation matrices / columns)."""
    a, b = pearson(original, cols), pearson(synthetic, cols).withColumnRenamed("r", "s")
    gap = F.coalesce("r", F.lit(0.0)) - F.coalesce("s", F.lit(0.0))
    one = a.join(F.broadcast(b), ["a", "b"]).agg(F.sqrt(2 * F.sum(gap * gap)).alias("norm"))
    return one.select("norm", (1 - F.least(F.lit(1.0), F.col("norm") / len(cols))).alias("similarity"))


def nearest_record(original: DataFrame, synthetic: DataFrame, cols: list[str], key: str, cell_rows: int = 256, most_cells: int = 65_536) -> DataFrame:
    """key, distance: from each synthetic row to the nearest original one, standardised by the original.

    Nulls and what is no number count as 0 before they are standardised; a column without spread is only centred. Repeated synthetic rows
    are returned each; without original rows the distances are null, without synthetic ones there are no rows.

    Of one column the distinct values of both sides are sorted in ranges, where each synthetic one lies between two original
    ones. Of several, the distinct original rows are dealt into cells (see ``_cells``) of some ``cell_rows`` rows; beyond
    ``cell_rows * most_cells`` rows the cells grow. Each distinct synthetic row meets a cell near it, then the cells in the order of the distance to their
    boxes, four times as many a round, as long as a box is nearer than the nearest row so far. So the distances are exact,
    and a row meets few cells. The boxes are a tree: only those that are nearer are opened. Boxes and counts of cells are all that is broadcast.
    """
    value = lambda c: F.coalesce(number(c), F.lit(0.0))
    stats = original.agg(*[f(value(c)).alias(f"{i}:{k}") for i, c in enumerate(cols) for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    scaled = [((value(c) - F.col(f"`{i}:m`")) / F.when(F.col(f"`{i}:s`") > 0, F.col(f"`{i}:s`")).otherwise(1.0)) for i, c in enumerate(cols)]
    z = lambda df: df.crossJoin(F.broadcast(stats)).select(*([F.col(key)] if df is synthetic else []), F.array(*[x + F.lit(0.0) for x in scaled]).alias("z"))
    if len(cols) == 1:
        own = z(synthetic).select(key, F.get("z", F.lit(0)).alias("x"))
        between = _between(z(original).select(F.get("z", F.lit(0)).alias("x")).distinct(), own.select("x").distinct())
        return own.join(between, "x").select(key, "distance")
    own = written(z(synthetic), "asked")
    distinct = written(z(original).distinct(), "distinct")
    known, tree = _cells(distinct, len(cols), cell_rows, most_cells)
    discard(distinct)
    best = written(own.select("z").distinct().withColumn("d", F.lit(None).cast("double")), "nearest")
    if tree is None:
        return own.select(key, F.lit(None).cast("double").alias("distance"))
    begin, count = 0, 1
    while True:
        asked = written(_cells_to_meet(best, tree, begin, begin + count), "cells")
        if asked.isEmpty():
            discard(asked)
            break
        old, met = best, written(_met(asked, known, len(cols)), "met")
        best = written(best.unionByName(met).groupBy("z").agg(F.min("d").alias("d")), "nearest")
        discard(asked, met, old)
        begin, count = begin + count, 4 * count
    return own.join(best, "z").select(key, F.sqrt("d").alias("distance"))


class _Tree(NamedTuple):
    """A binary tree of boxes: node i has the children 2 i and 2 i + 1; the leaves are the cells, from ``first`` on. Nodes without rows have an endless distance."""

    first: int
    low: np.ndarray  # a row for each node
    high: np.ndarray

    def bound(self, x: np.ndarray, node: np.ndarray) -> np.ndarray:
        """The squared distance from each x to the box of its node, rounded down."""
        out = np.zeros(len(x))
        for i in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[node, i] - x[:, i], x[:, i] - self.high[node, i]), 0)
            out += gap * gap
        return out * (1 - 1e-12)  # whatever rounding adds, no nearer row is passed over

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """A cell near each x: from the root down to the child whose box is nearer."""
        node = np.ones(len(x), np.int64)
        while node[0] < self.first if len(node) else False:
            node = 2 * node
            node += (self.bound(x, node + 1) < self.bound(x, node)) | (self.low[node, 0] > self.high[node, 0])
        return node

    def within(self, x: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """row, cell, bound: of each x all cells whose box is nearer than its d; only boxes that are nearer are opened."""
        row, node = np.arange(len(x)), np.ones(len(x), np.int64)
        while True:
            bound = self.bound(x[row], node)
            near = bound < d[row]
            row, node, bound = row[near], node[near], bound[near]
            if not len(node) or node[0] >= self.first:
                return row, node, bound
            row, node = np.repeat(row, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()


def _cells(known: DataFrame, width: int, cell_rows: int, most_cells: int) -> tuple[DataFrame, _Tree | None]:
    """known (rows z, all distinct) as a written table of o and cell, and the tree of the cells' bounds; None without rows.

    The cells are those of a tree that halves its rows at the median of the widest column. It is built from a sample of some 16 rows
    a cell, chosen by hash; which rows are in it bears on the cells' sizes only.
    """
    rows = known.count()
    depth = max(0, min(most_cells, -(-rows // cell_rows)) - 1).bit_length()
    share = 16 * 2**depth / max(rows, 1)
    drawn = known if share >= 1 else known.filter(F.pmod(F.xxhash64("z"), F.lit(1 << 40)) < int(share * (1 << 40)))
    sample = np.array([r.z for r in drawn.collect()], np.float64).reshape(-1, width)  # 16 rows a cell
    axis, cut = np.zeros(2**depth, np.int64), np.full(2**depth, np.inf)
    parts = {1: sample}
    for node in range(1, 2**depth):
        held = parts.pop(node)
        if len(held):
            axis[node] = int(np.ptp(held, axis=0).argmax())
            cut[node] = np.median(held[:, axis[node]])
        right = held[:, axis[node]] >= cut[node]
        parts[2 * node], parts[2 * node + 1] = held[~right], held[right]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            node = np.ones(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + (x[np.arange(len(x)), axis[node]] >= cut[node])
            yield pa.RecordBatch.from_arrays([batch.column("z"), pa.array(node.astype(np.int32))], ["o", "cell"])

    dealt = written(known.mapInArrow(deal, "o array<double>, cell int"), "known")
    ends = [f(F.get("o", F.lit(i))) for f in (F.min, F.max) for i in range(width)]
    boxes = dealt.groupBy("cell").agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).collect()  # most_cells rows at most
    if not boxes:
        return dealt, None
    low, high = np.full((2 ** (depth + 1), width), np.inf), np.full((2 ** (depth + 1), width), -np.inf)
    for cell, *e in boxes:
        low[cell], high[cell] = e[:width], e[width:]
    for node in range(2**depth - 1, 0, -1):
        low[node], high[node] = np.minimum(low[2 * node], low[2 * node + 1]), np.maximum(high[2 * node], high[2 * node + 1])
    return dealt, _Tree(2**depth, low, high)


def _cells_to_meet(best: DataFrame, tree: _Tree, begin: int, end: int) -> DataFrame:
    """z, cell: at first one cell near each row; then of its cells that are nearer than d those from place ``begin - 1`` to before ``end - 1`` in the order of their distance."""
    shared = best.sparkSession.sparkContext.broadcast(tree)

    def near(x: np.ndarray, d: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held = shared.value
        if begin == 0:
            yield np.arange(len(x)), held.nearest(x)
            return
        size, at = 64, 0
        while at < len(x):  # so many rows at once that some million boxes are held
            part = slice(at, at + size)
            row, cell, bound = held.within(x[part], d[part])
            order = np.lexsort((cell, bound, row))
            row, cell = row[order], cell[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            taken = (place >= begin - 1) & (place < end - 1)
            yield row[taken] + at, cell[taken]
            at, size = at + size, max(1, min(4 * size, 500_000 * size // max(len(row), 1), 65_536))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            d = batch.column("d").fill_null(np.inf).to_numpy(zero_copy_only=False)
            for row, cell in near(x, d):
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column("z").take(pa.array(row)), pa.array(cell.astype(np.int32))], ["z", "cell"])

    return best.mapInArrow(meet, "z array<double>, cell int")


#: A cell that more rows ask for is dealt to several groups, each with all of the cell's own rows.
_ASKED_ROWS = 16_384


def _met(asked: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """z, d: the squared distance from each asked z to the nearest row of its cell.

    Each task reads its cells one after the other: a cell's own rows, which it holds, then the rows that ask for it.
    """
    groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / _ASKED_ROWS).cast("int").alias("groups_"))  # most_cells rows at most
    dealt = asked.join(F.broadcast(groups), "cell").select("cell", F.pmod(F.xxhash64("z"), F.col("groups_")).cast("int").alias("group"), F.lit(True).alias("asks"), "z")
    held = known.join(F.broadcast(groups), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("groups_") - 1)).alias("group"), F.lit(False).alias("asks"), F.col("o").alias("z"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in batches:
            x = batch.column("z").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            names = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "group")], 1)
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(1) | (asks[1:] != asks[:-1])]) if len(x) else []
            d = np.empty(len(x))
            for a, b in zip(starts, [*starts[1:], len(x)]):
                if tuple(names[a]) != group:
                    group, own = tuple(names[a]), []
                if not asks[a]:
                    own.append(x[a:b])
                    continue
                own = [np.concatenate(own)]
                step = max(1, 500_000 // len(own[0]))
                for s in range(a, b, step):
                    part = x[s : min(b, s + step)]
                    square = np.zeros((len(part), len(own[0])))
                    for i in range(width):
                        gap = part[:, i, None] - own[0][None, :, i]
                        square += gap * gap
                    d[s : s + len(part)] = square.min(1)
            rows = np.flatnonzero(asks)
            yield pa.RecordBatch.from_arrays([batch.column("z").take(pa.array(rows)), pa.array(d[rows])], ["z", "d"])

    together = dealt.unionByName(held).repartition("cell", "group").sortWithinPartitions("cell", "group", "asks")
    return together.mapInArrow(measure, "z array<double>, d double")


def _between(known: DataFrame, asked: DataFrame) -> DataFrame:
    """x of asked, distance to the nearest x of known: the last one before and the first one after, within ranges of x and over their edges."""
    both = known.withColumn("o", F.col("x")).unionByName(asked.withColumn("o", F.lit(None).cast("double")))
    values = both.groupBy("x").agg(F.max("o").alias("o"), F.count_if(F.col("o").isNull()).alias("asked"))
    ranged = written(values.repartitionByRange("x").withColumn("range_", F.spark_partition_id()), "ranges")
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("range_").agg(F.min("o").alias("least"), F.max("o").alias("most"))
    ends = ends.select("range_", F.max("most").over(earlier(Window.orderBy("range_"))).alias("ahead"), F.min("least").over(earlier(Window.orderBy(F.desc("range_")))).alias("behind"))  # one row a range
    # Both ways look back, as a frame that looks ahead is read anew for each row.
    own = Window.partitionBy("range_")
    near = ranged.withColumns({"low": F.last("o", ignorenulls=True).over(so_far(own.orderBy("x"))), "high": F.last("o", ignorenulls=True).over(so_far(own.orderBy(F.desc("x"))))})
    near = near.filter("asked > 0").join(F.broadcast(ends), "range_")
    return near.select("x", F.least(F.col("x") - F.coalesce("low", "ahead"), F.coalesce("high", "behind") - F.col("x")).alias("distance"))


def closest_risk(distances: DataFrame, columns: int) -> DataFrame:
    """One row: mean distance, and risk = exp(-mean / sqrt(columns))."""
    return distances.agg(F.avg("distance").alias("mean_distance")).withColumn("risk", F.exp(-F.col("mean_distance") / (columns**0.5)))


def quality_score(original: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """column, score: numeric by mean and std, categorical by the overlap of distinct values."""
    out = None
    if numeric:
        stats = lambda df, p: df.agg(*[f(number(c)).alias(f"{p}{k}{i}") for i, c in enumerate(numeric) for k, f in (("m", F.avg), ("s", F.stddev_samp))])
        one = stats(original, "a").crossJoin(F.broadcast(stats(synthetic, "b")))

        def score(i: int):
            part = lambda k: F.greatest(F.lit(0.0), 1 - F.abs(F.col(f"a{k}{i}") - F.col(f"b{k}{i}")) / (F.col(f"as{i}") + 1e-6))
            return (part("m") + part("s")) / 2

        out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), score(i).alias("score")) for i, c in enumerate(numeric)])).alias("r")).select("r.*")
    if categorical:
        a, b = unpivot(original, categorical).distinct(), unpivot(synthetic, categorical).distinct().withColumn("hit_", F.lit(1))
        j = a.join(b, a["column"].eqNullSafe(b["column"]) & a["value"].eqNullSafe(b["value"]), "left")
        cat = j.groupBy(a["column"]).agg((F.count("hit_") / F.count("*")).alias("score"))
        out = cat if out is None else out.unionByName(cat)
    return out


def comparison_report(original: DataFrame, synthetic: DataFrame, cols: list[str]) -> DataFrame:
    """column, metric, original, synthetic, difference."""
    from .profile import numeric_profile

    metrics = ("mean", "std", "min", "max", "q50")
    long = lambda df, to: numeric_profile(df, cols).select("column", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias(to)) for m in metrics])).alias("r")).select("column", "r.*")
    j = long(original, "original").join(F.broadcast(long(synthetic, "synthetic")), ["column", "metric"])
    return j.withColumn("difference", F.col("synthetic") - F.col("original"))


def audit(*risks: DataFrame) -> DataFrame:
    """One row: the worst of the risk levels."""
    order = F.when(F.col("risk") == "high", 2).when(F.col("risk") == "medium", 1).otherwise(0)
    stacked = None
    for r in risks:
        own = r.select(order.alias("o"))
        stacked = own if stacked is None else stacked.unionByName(own)
    worst = F.max("o")
    return stacked.agg(F.when(worst == 2, "high").when(worst == 1, "medium").otherwise("low").alias("risk"))


def date_similarity(original: DataFrame, synthetic: DataFrame, col: str) -> DataFrame:
    """One row: range of days on both sides, score = 1 - their difference over the original's, at least 0."""
    span = lambda df, to: df.agg(F.datediff(F.max(col), F.min(col)).cast("double").alias(to))
    one = span(original, "original_days").crossJoin(F.broadcast(span(synthetic, "synthetic_days")))
    gap = F.abs(F.col("original_days") - F.col("synthetic_days")) / F.greatest(F.col("original_days"), F.lit(1.0))
    return one.withColumn("score", F.greatest(F.lit(0.0), 1 - gap))


def statistical_similarity(original: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One row: mean column score, correlation similarity, similarity of the principal components' variances, and the mean of the three."""
    from .learn import pca_similarity

    scores = numeric_similarity(original, synthetic, numeric).select("score").unionByName(categorical_similarity(original, synthetic, categorical).select("score"))
    one = scores.agg(F.avg("score").alias("columns"))
    joined = one.crossJoin(F.broadcast(correlation_similarity(original, synthetic, numeric).select(F.col("similarity").alias("correlation"))))
    joined = joined.crossJoin(F.broadcast(pca_similarity(original, synthetic, numeric).select(F.col("similarity").alias("components"))))
    return joined.withColumn("similarity", (F.col("columns") + F.col("correlation") + F.col("components")) / 3)
