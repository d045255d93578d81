"""Vector code compression: product codes whose codebooks are searched by kd-trees."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, new_column, ship
from .vectors import check_size, matrix, whole_vectors

PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 8


class KdTree:
    """The entries of one codebook: boxes split at the median of their widest side, up to LEAF entries in a leaf.

    Many queries go down together. Each visits the half that it lies in first, then the other if the squared distance to its
    box is at most the best so far. Boxes at an equal distance are visited too, as they may hold an entry of a lower index.
    """

    def __init__(self, entries: np.ndarray, leaf: int = LEAF) -> None:
        self.entries, self.leaf = entries.astype(np.int64), leaf
        self.nodes: list[tuple] = []
        self._build(np.arange(len(entries)))

    def _build(self, held: np.ndarray) -> int:
        inside = self.entries[held]
        low, high = inside.min(axis=0), inside.max(axis=0)
        at, axis = len(self.nodes), int((high - low).argmax())
        self.nodes.append(())
        if len(held) <= self.leaf or low[axis] == high[axis]:
            self.nodes[at] = (low, high, np.sort(held))
            return at
        order = held[np.argsort(inside[:, axis], kind="stable")]
        half = len(order) // 2
        self.nodes[at] = (low, high, axis, self.entries[order[half], axis], self._build(order[:half]), self._build(order[half:]))
        return at

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the nearest entry of each row of x (equal distances: the lowest) and the squared distance."""
        check_size(x, self.entries, len(self.entries))
        best = np.full(len(x), np.iinfo(np.int64).max)  # distance * entries + index, which orders both
        self._visit(0, x, np.arange(len(x)), best)
        return best % len(self.entries), best // len(self.entries)

    def _visit(self, node: int, x: np.ndarray, at: np.ndarray, best: np.ndarray) -> None:
        if not len(at):
            return
        if len(self.nodes[node]) == 3:
            held = self.nodes[node][2]
            apart = x[at][:, None, :] - self.entries[held]
            keys = np.einsum("ijk,ijk->ij", apart, apart) * len(self.entries) + held
            best[at] = np.minimum(best[at], keys.min(axis=1))
            return
        _, _, axis, cut, left, right = self.nodes[node]
        is_left = x[at, axis] < cut
        here, there = at[is_left], at[~is_left]
        self._visit(left, x, here, best)
        self._visit(right, x, there, best)
        self._visit(right, x, self._within(right, x, here, best), best)
        self._visit(left, x, self._within(left, x, there, best), best)

    def _within(self, node: int, x: np.ndarray, at: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Of the queries ``at`` those whose distance to the node's box is at most their best."""
        low, high = self.nodes[node][:2]
        out = np.maximum(low - x[at], 0) + np.maximum(x[at] - high, 0)
        return at[(out * out).sum(axis=1) * len(self.entries) <= best[at]]


def _cut(x: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(x, parts, axis=1)


def _sums(kept: DataFrame, trees, parts: int, entries: int, width: int) -> DataFrame:
    """part, entry, n, s0, s1, ...: count and sums of the parts nearest to each entry; each task adds its own up first."""
    names = [f"s{i}" for i in range(width)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            for p, x in enumerate(_cut(matrix(batch.column("v")), parts) if batch.num_rows else ()):
                index, _ = trees.value[p].nearest(x)
                for i, values in enumerate((None, *x.T)):
                    total[p * entries : (p + 1) * entries, i] += np.bincount(index, values, entries).astype(np.int64)  # exact: a batch's sums stay under 2**53
        at = np.flatnonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array((at // entries).astype(np.int32)), pa.array((at % entries).astype(np.int32)), *map(pa.array, total[at].T)], ["part", "entry", "n", *names])

    own = kept.select("v").mapInArrow(add, "part int, entry int, n long, " + ", ".join(f"{c} long" for c in names))
    return own.groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in ("n", *names)])


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """A written table of id_col, the columns ``keep``, code and error, and the codebooks (one array of entries a part).

    Dropped are vectors that are null or hold null or non-finite components. Components are floor(scale * x), cut into equal
    consecutive parts. Each part's codebook starts as that part of the vectors of the smallest identifiers (nulls last, repeated
    identifiers in order of their vectors; of fewer vectors than entries, all). Each round assigns every part
    to the nearest entry (equal distances: the lower index) and moves each used entry to the floor of its parts' mean; then
    parts are assigned again. code: the indexes in two hexadecimal digits each; error: the squared distances, summed.
    The vector of the smallest identifier sets the length; one of another length, or any where parts don't divide
    the length, has null as code and error and bears on no codebook. Repeated rows count and are returned each; an empty table gives
    none, and no codebooks. Of other columns only ``keep`` are read; one of these named code or error raises.

    Each round broadcasts one kd-tree a part (parts * entries * width numbers, whatever the input). Tasks return sums by part and entry,
    so the driver gets parts * entries rows. Everything is computed from one written table of whole-number vectors, which lost executors read again.
    """
    spark = vectors.sparkSession
    ship(spark)
    if entries > 256:
        raise ValueError("two hexadecimal digits hold 256 entries at most")
    asked = vectors.select(id_col, *keep)
    for name in ("code", "error"):
        new_column(asked, name)
    stored = {"id": id_col, **{f"k{i}": c for i, c in enumerate(keep)}}
    kept = whole_vectors(vectors, stored, vec_col, scale)
    order = F.col("id").asc_nulls_last()
    first = kept.select("id", "v").orderBy(order, "v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    fits = dim > 0 and dim % parts == 0
    usable = kept.filter(F.size("v") == dim) if fits else kept.limit(0)
    start = [r.v for r in usable.select("id", "v").orderBy(order, "v").limit(entries).collect()]
    books = _cut(np.array(start, np.int64).reshape(len(start), dim), parts) if start else []
    for _ in range(rounds if start else 0):
        trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
        rows = _sums(usable, trees, parts, len(start), dim // parts).collect()  # parts * entries rows at most
        for r in rows:
            books[r.part][r.entry] = [r[f"s{i}"] // r.n for i in range(dim // parts)]
        trees.unpersist()
    trees = spark.sparkContext.broadcast([KdTree(b) for b in books])
    schema = T.StructType([f for f in kept.schema.fields if f.name != "v"] + [T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [trees.value[p].nearest(x) for p, x in enumerate(_cut(matrix(batch.column("v")), parts))]
                digits = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
                codes = pa.array([digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in stored], codes, pa.array(sum(d for _, d in found))], [*stored, "code", "error"])

    coded = usable.mapInArrow(encode, schema)
    others = kept.filter(F.size("v") != dim) if fits else kept
    coded = coded.unionByName(others.select(*stored, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")))
    out = materialize(coded.select(*[F.col(c).alias(name) for c, name in stored.items()], "code", "error"), "codes")
    trees.unpersist()
    forget(kept)
    return out, books


def decode(codes: DataFrame, books: list[np.ndarray], to: str = "vector", scale: int = SCALE) -> DataFrame:
    """codes with the vectors that their column ``code`` stands for, as doubles in the new column ``to``; a null code gives null."""
    new_column(codes, to)
    if not books:
        return codes.withColumn(to, F.lit(None).cast("array<double>"))
    stated = json.dumps([(b / scale).tolist() for b in books])
    entry = F.from_json(F.lit(stated), "array<array<array<double>>>")  # parts * entries * width numbers
    index = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn(to, F.when(F.col("code").isNotNull(), F.concat(*[F.get(F.get(entry, F.lit(p)), index(p)) for p in range(len(books))])))


def summed_over(coded: DataFrame, group: str, value: str, to: str) -> DataFrame:
    """coded with the sum of ``value`` over rows of equal ``group``, nulls together, in the new column ``to``.

    coded must be a written table: it meets one row a group, so a group of any size can be split.
    """
    new_column(coded, to)
    sums = materialize(coded.groupBy(F.col(group).alias("group_")).agg(F.sum(value).alias(to)), "sums")
    return coded.join(sums, F.col(group).eqNullSafe(F.col("group_")), "left").drop("group_")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()
