"""Centroid clustering and vector codes against brute force in plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from compare_rows import same

from mirrorloom.llm import centroids, queries, vector_codes
from mirrorloom.llm.vectors import squared_distances

SCHEMA = "vec_id long, embedding array<float>, label int, owner int, v string, distance long, id string"


def vectors(n, dim, seed=1):
    """Clumped vectors with ties, repeated rows, nulls, non-finite components, other lengths and a null identifier."""
    rng = random.Random(seed)
    middles = [[rng.uniform(-2, 2) for _ in range(dim)] for _ in range(7)]
    rows = [(i, [round(x + rng.uniform(-0.3, 0.3), 1) for x in rng.choice(middles)], i % 4 or None) for i in range(n)]
    same_vector = [0.5] * dim
    rows += [(1000 + i, same_vector, 9) for i in range(n // 2)]  # a hot vector
    rows += [rows[0], rows[0], (None, [0.25] * dim, None)]
    rows += [(2000, None, 1), (2001, [], 1), (2002, [math.nan] * dim, 1), (2003, [math.inf] + [0.0] * (dim - 1), 2), (2004, [None] + [0.0] * (dim - 1), None), (2005, [0.5] * (dim + 1), 2)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 1, "y") for r in rows], SCHEMA)


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def closest(v, entries):
    d, i = min((apart(v, e), i) for i, e in enumerate(entries))
    return i, d


def moved(entries, groups):
    return [[sum(c) // len(g) for c in zip(*g)] if g else e for e, g in zip(entries, groups)]


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, whole(v)) for i, v, _ in rows if sound(v) and len(v) == dim]
    order = sorted((hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    cents = [v for _, v in order[:k]]
    for _ in range(rounds):
        groups = [[] for _ in cents]
        for _, v in kept:
            groups[closest(v, cents)[0]].append(v)
        cents = moved(cents, groups)
    got = [(i, *closest(v, cents)) for i, v in kept]
    own = {c: sum(d for _, x, d in got if x == c) for c in range(len(cents))}
    return sorted([(i, c, d, own[c], sum(own.values()), cents[c]) for i, c, d in got], key=str)


def clusters(df, **how):
    return sorted([(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, list(r.centroid)) for r in centroids.cluster(df, **how).collect()], key=str)


@pytest.mark.parametrize("k, rounds", [(5, 4), (12, 2), (400, 3), (3, 0)])
def test_clusters_against_brute_force(spark, k, rounds):
    rows = vectors(90, 8)
    assert clusters(frame(spark, rows), k=k, rounds=rounds, dim=8) == brute_clusters(rows, k, rounds, 8)


def test_clusters_after_they_have_settled(spark):
    rows = vectors(40, 4, seed=5)
    assert clusters(frame(spark, rows), k=3, rounds=40, dim=4) == brute_clusters(rows, 3, 40, 4)


def test_clusters_of_nothing(spark):
    assert clusters(frame(spark, []), dim=8) == []
    assert clusters(frame(spark, vectors(10, 8)), dim=3) == []


def test_delta_meets_only_what_can_have_changed():
    """A vector whose owner stayed is never compared with a centroid that stayed; a tie goes to the smaller number."""
    rng = np.random.default_rng(2)
    x, old = rng.integers(-9, 9, (300, 3)), rng.integers(-9, 9, (10, 3))
    none = np.full(300, -1)
    owner, distance = centroids.nearest(x, none, none, old, np.ones(10, bool))
    new, changed = old.copy(), np.zeros(10, bool)
    new[[2, 7]] += 1
    changed[[2, 7]] = True
    got = centroids.nearest(x, owner, distance, new, changed)
    d = squared_distances(x, new)
    assert (got[0] == d.argmin(axis=1)).all() and (got[1] == d.min(axis=1)).all()
    met = []
    keep = centroids.squared_distances
    centroids.squared_distances = lambda a, b: met.append((len(a), len(b))) or keep(a, b)
    try:
        centroids.nearest(x, owner, distance, new, changed)
    finally:
        centroids.squared_distances = keep
    lost = int(changed[owner].sum())
    assert met == [(lost, 10), (300 - lost, 2)]


def test_large_components_are_exact_or_refused():
    x, c = np.array([[2**29, -(2**29)]]), np.array([[-(2**29), 2**29], [0, 1]])
    assert squared_distances(x, c).tolist() == [[2 * 2**60, 2**58 + (2**29 + 1) ** 2]]
    with pytest.raises(ValueError, match="too large"):
        squared_distances(x * 2**3, c)


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, whole(v), label) for i, v, label in rows if sound(v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dim = len(order[0][1])
    width = dim // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    usable = [r for r in order if len(r[1]) == dim]
    books = [[cut(v)[p] for _, v, _ in usable[:entries]] for p in range(parts)]
    for _ in range(rounds):
        for p in range(parts):
            groups = [[] for _ in books[p]]
            for _, v, _ in usable:
                groups[closest(cut(v)[p], books[p])[0]].append(cut(v)[p])
            books[p] = moved(books[p], groups)
    out = []
    for i, v, label in kept:
        found = [closest(x, books[p]) for p, x in enumerate(cut(v))] if len(v) == dim else None
        out.append((i, label, found and "".join(f"{e:02x}" for e, _ in found), found and sum(d for _, d in found)))
    return sorted(out, key=str), books


def codes(df, **how):
    coded, books = vector_codes.compress(df, keep=("label",), **how)
    return coded, sorted([(r.vec_id, r.label, r.code, r.error) for r in coded.collect()], key=str), [b.tolist() for b in books]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 16, 2), (2, 64, 3), (8, 256, 1), (4, 5, 0)])
def test_codes_against_brute_force(spark, parts, entries, rounds):
    rows = vectors(80, 8, seed=parts)
    want, books = brute_codes(rows, parts, entries, rounds)
    coded, got, learned = codes(frame(spark, rows), parts=parts, entries=entries, rounds=rounds)
    assert (got, learned) == (want, books)
    assert vector_codes.books_digest([np.array(b) for b in learned]) == hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    own = {}
    for _, label, _, error in want:
        own[label] = own.get(label, 0) + (error or 0)
    assert all(own[r.label] == r.total for r in vector_codes.summed_over(coded, "label", "error", "total").collect())


def test_codes_stand_for_their_entries(spark):
    rows = vectors(60, 8)
    coded, _, books = codes(frame(spark, rows), parts=4, entries=16)
    for r in vector_codes.decode(coded, [np.array(b) for b in books]).collect():
        if r.code is None:
            assert r.vector is None
        else:
            assert r.vector == [x / 256 for p in range(4) for x in books[p][int(r.code[2 * p : 2 * p + 2], 16)]]


def test_codes_of_nothing_and_of_odd_lengths(spark):
    assert codes(frame(spark, []))[1:] == ([], [])
    _, got, books = codes(frame(spark, [(1, [1.0, 2.0, 3.0], 1)]), parts=2)
    assert got == [(1, 1, None, None)] and books == []
    with pytest.raises(ValueError, match="code"):
        vector_codes.compress(frame(spark, []).withColumnRenamed("v", "code"), keep=("code",))
    with pytest.raises(ValueError, match="256"):
        vector_codes.compress(frame(spark, []), entries=257)


@pytest.mark.parametrize("seed", range(6))
def test_tree_finds_the_lowest_of_equal_entries(seed):
    """Few different values, so many distances tie and many boxes stand at the same bound."""
    rng = np.random.default_rng(seed)
    entries, x = rng.integers(-2, 3, (64, 4)), rng.integers(-4, 5, (500, 4))
    tree = vector_codes.KdTree(entries, leaf=1 + seed)
    index, distance = tree.nearest(x)
    d = squared_distances(x, entries)
    assert (index == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_centroids", "op13_vector_codes"])
def test_queries_against_sql(spark, duck, small, name):
    same(queries.queries()[name](spark, small), duck.sql(queries.oracle_sql()[name]))
