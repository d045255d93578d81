"""SimHash near-duplicates: fingerprints, meet-in-the-middle ball hashing, connected classes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, materialize, ship

SHINGLE, RADIUS = 3, 2
#: Looser copies: shingles of CLOSE words that agree by SIMILARITY (Jaccard) or more. Two texts at 0.8
#: share one of 32 bands of 8 smallest hashes with a probability of 0.997.
CLOSE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 8


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text as a signed number; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    parts = [b" ".join(words)] if len(words) <= width else map(b" ".join, zip(*(islice(words, i, None) for i in range(width))))
    digest = xxhash.xxh64_intdigest
    total, over = 0, np.zeros(64, np.int64)
    block: list[int] = []

    def add() -> None:
        nonlocal total, over
        bits = np.unpackbits(np.array(block, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += len(block)
        over += bits.sum(axis=0, dtype=np.int64)
        block.clear()

    for part in parts:
        block.append(digest(part, 42))
        if len(block) == 65_536:  # bounds the memory of a very long text
            add()
    if block:
        add()
    return int(np.packbits(2 * over > total).view(">u8")[0].astype(np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, text_col: str = "text", to: str = "fp", width: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint of text_col in the new column ``to``."""

    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(to, of(F.col(text_col).cast("string")))


def ball_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b), a > b as signed numbers, that join all distinct fingerprints within the radius.

    Every fingerprint emits all variants within half the radius, so two fingerprints
    within the radius meet in one variant at least. Those that meet are at most twice the
    half apart, and few (65 for radius 2) can meet in one variant, whatever the input. So
    linking each to the smallest it meets joins all of them; each link's bits are verified.
    """
    if radius < 0 or radius % 2:
        raise ValueError("the radius must be even: variants then meet within the radius")
    flips = "flatten(transform(v, x -> transform(sequence(0, 63), i -> x ^ shiftleft(1L, i))))"
    # Dealt out before they grow 65-fold, so that no task emits more than its part.
    balls = fps.repartition("fp").select("fp", F.array("fp").alias("v"))
    for _ in range(radius // 2):
        balls = balls.select("fp", F.array_distinct(F.concat("v", F.expr(flips))).alias("v"))
    emitted = balls.select("fp", F.explode("v").alias("variant"))
    met = emitted.withColumn("b", F.min("fp").over(Window.partitionBy("variant"))).filter("fp <> b")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= radius
    return met.filter(near).select(F.col("fp").alias("a"), "b").distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether each node has one link to a smaller one at most, and only nodes without one are linked to."""
    up = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = up.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1 AND up > 0").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); the root is the component's smallest node.

    Large-star and small-star rounds until all links are stars; every round is written to the shared
    folder. A hub's links lie on one side of a join with one row per node, which adaptive execution splits.
    """
    star = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    while not _are_stars(star):
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = materialize(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        forget(star, least)
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        star = materialize(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "small")
        forget(large, least)
    roots = star.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))


def _prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """Written tables: (doc_id, fp) of every document, and the smallest identifier of every fingerprint (fp, least_id)."""
    prints = materialize(fingerprints(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "t", "fp", width).select("doc_id", "fp"), "fingerprints")
    first = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "first")
    return prints, first


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id.

    Lower-cases A-Z, takes words between ASCII white space and shingles of ``width`` words,
    repeats included; a text with fewer words is one shingle, one without words (null, empty)
    has fingerprint zero and links like any other. component_id is the smallest identifier
    reachable; null identifiers are ignored in it, so a class of nulls only has null. Repeated
    rows each give a row. Copies share a fingerprint and are never expanded into pairs.
    """
    prints, first = _prints(docs, id_col, text_col, width)
    roots = materialize(components(ball_links(first.select("fp"), radius)), "roots")
    met = roots.join(first, roots.node == first.fp).groupBy("root").agg(F.min("least_id").alias("component_id"))
    met = materialize(met, "classes")
    linked = roots.join(met, "root").select(F.col("node").alias("fp"), "component_id")
    classes = materialize(first.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least_id").alias("component_id")), "classes")
    return prints.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = CLOSE) -> np.ndarray:
    """The sorted distinct 32-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint32)
    width = min(width, len(words))
    digests = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    mixed = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + digests[i : i + len(mixed)]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique((mixed >> np.uint64(32)).astype(np.uint32))


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key a band, from the smallest of the shingles under each of bands x rows linear maps."""
    maps = np.random.default_rng(7).integers(0, 2**32, (2, bands * rows, 1), np.uint32)
    factor, shift = maps[0] | np.uint32(1), maps[1]
    least = np.full(bands * rows, 2**32 - 1, np.uint32)
    for at in range(0, len(shingles), 2048):  # bounds the memory of a very long text
        np.minimum(least, (shingles[at : at + 2048] * factor + shift).min(axis=1), out=least)
    keys = np.arange(bands, dtype=np.uint64)
    for column in least.reshape(bands, rows).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


def close_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = CLOSE, similarity: float = SIMILARITY) -> DataFrame:
    """Links (a, b), a > b, of documents whose shingle sets agree by ``similarity`` or more.

    A ball of the radius that such texts need can't be emitted, so candidates come from bands of
    smallest hashes: each document meets the smallest identifier of each of its bands, never
    all the others, so links grow with the documents, whatever a band holds. Every candidate's
    whole shingle sets are compared. Null identifiers and texts without words give no link;
    rows that repeat an identifier are each compared.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("n int, bands array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t, width) for t in texts]
            yield pd.DataFrame({"n": pd.Series(map(len, sets), dtype="int32"), "bands": pd.Series(map(band_keys, sets), dtype="object")})

    @F.pandas_udf("array<int>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t, width).view(np.int32) for t in texts], dtype="object")

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).filter("id IS NOT NULL")
    sketches = materialize(texts.select("id", sketch("t").alias("s")), "sketches")
    bands = sketches.filter("s.n > 0").select("id", F.col("s.n").alias("n"), F.explode("s.bands").alias("band"))
    least = materialize(bands.groupBy("band").agg(F.min("id").alias("b"), F.count("*").alias("members")).filter("members > 1").drop("members"), "bands")
    met = materialize(bands.join(least, "band").filter("id > b").select(F.col("id").alias("a"), F.col("n").alias("n_a"), "b").distinct(), "met")
    sizes = sketches.select(F.col("id").alias("b"), F.col("s.n").alias("n_b"))
    alike = F.least("n_a", "n_b") >= (similarity - 1e-9) * F.greatest("n_a", "n_b")
    # Not distinct here: an aggregate by (a, b) would keep adaptive execution from splitting a common b.
    pairs = materialize(met.join(sizes, "b").filter(alike).select("a", "b"), "pairs")
    forget(least, met)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialize(texts.join(wanted, "id", "left_semi").select("id", shingles("t").alias("set")), "sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    links = materialize(both.filter(F.col("common") >= (similarity - 1e-9) * (F.col("sum") - F.col("common"))).select("a", "b"), "close")
    forget(sketches, pairs, sets)
    return links.distinct()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, radius: int = RADIUS, similarity: float = SIMILARITY) -> DataFrame:
    """The documents whose identifier is the smallest of their class, with all their columns.

    Classes follow the links of equal and of near fingerprints, and those of close_links. Documents without
    an identifier stay and link no others; of rows that repeat an identifier, all stay or go (an exact
    deduplication before removes them).
    """
    (gone,) = fresh(docs, "gone_id")
    prints, first = _prints(docs, id_col, text_col, width)
    same = prints.join(first, "fp").filter("doc_id <> least_id").select(F.col("doc_id").alias("a"), F.col("least_id").alias("b")).distinct()
    of = [first.select(F.col("fp").alias(c), F.col("least_id").alias(f"least_{c}")) for c in "ab"]
    ball = ball_links(first.filter("least_id IS NOT NULL").select("fp"), radius).join(of[0], "a").join(of[1], "b")
    links = same.unionByName(ball.select(F.col("least_a").alias("a"), F.col("least_b").alias("b")))
    links = links.unionByName(close_links(docs, id_col, text_col, similarity=similarity))
    dropped = components(links).filter("node <> root").select(F.col("node").alias(gone))
    return docs.join(dropped, docs[id_col] == F.col(gone), "left_anti")
