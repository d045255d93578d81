"""Exact and near deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from cases import docs, none

from mirrorloom.llm import exact_dedup, queries, simhash


def test_exact_dedup(spark):
    df = docs(spark)
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    want = []
    for i, t in rows:
        keep = max((x for x in groups[t] if x is not None), default=None)
        want.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, exact_dedup.exact_dedup(df).collect()))) == sorted(map(str, want))


def test_dedup_keeps_one_row_each(spark):
    out = exact_dedup.dedup(docs(spark))
    assert out.columns == docs(spark).columns
    kept = [(r.doc_id, r.text or "") for r in out.collect()]
    assert len({t for _, t in kept}) == len(kept) and (1005, docs(spark).first().text) in kept and (0, docs(spark).first().text) not in kept


def test_run_counts_give_the_same(spark):
    d = exact_dedup.digest_runs(docs(spark)).repartition(16)
    got = [sorted(map(tuple, exact_dedup.merge_runs(d, n).collect()), key=str) for n in (2, 16, 64)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len({t or "" for (t,) in docs(spark).select("text").collect()})
    with pytest.raises(ValueError):
        exact_dedup.merge_runs(d, 6)


def test_rounds_merge_sorted_runs(spark):
    """Each binomial round sorts its runs, exchanges them and merges them in order; no aggregation hashes."""
    plan = exact_dedup.merge_runs(exact_dedup.digest_runs(docs(spark)), 16)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("SortAggregate", plan)) == 8 and len(re.findall("Exchange hashpartitioning", plan)) == 4 and "HashAggregate" not in plan.replace("SortAggregate", "")
    assert len(re.findall(r" Sort \[", plan)) >= 8


def test_empty(spark):
    assert exact_dedup.exact_dedup(none(spark)).count() == 0 and exact_dedup.dedup(none(spark)).count() == 0
    assert simhash.near_classes(none(spark)).count() == 0 and simhash.near_dedup(none(spark)).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64(p, seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return sorted([(d, f"{f:016x}", least.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fp))], key=str)


def test_near_classes_against_brute_force(spark):
    long = [" ".join(f"w{(i * k) % 97}" for i in range(400)) for k in range(3, 40)]
    near = [(2000 + i, x.replace("w5 ", "w6 ", 1)) for i, x in enumerate(long)] + [(3000 + i, x) for i, x in enumerate(long)] + [(4000 + i, x + " end") for i, x in enumerate(long)]
    df = docs(spark, near)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, simhash.near_classes(df).collect()), key=str) == brute_classes(rows)


def test_op3_query_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.op3_simhash(spark, small).collect()), key=str) == brute_classes(rows)


def brute_close(rows):
    """The links that whole shingle sets of five words give at 0.8 or more, as pairs (larger, smaller)."""
    sets = {}
    for i, t in rows:
        words = (t or "").encode().lower().split()
        if words and i is not None:
            sets[i] = {b" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))}
    order = sorted(sets, key=lambda i: len(sets[i]))
    found = set()
    for at, i in enumerate(order):
        for j in order[at + 1 :]:
            if len(sets[i]) < 0.8 * len(sets[j]):
                break
            common = len(sets[i] & sets[j])
            if common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                found.add((max(i, j), min(i, j)))
    return found


def roots_of(pairs):
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    return {i: find(i) for i in parent}


def test_close_links_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    base = [f"v{i * i % 1009}" for i in range(300)]
    loose = [" ".join("x" if k in {i * 37 % 300, i * 91 % 300, i * 13 % 300} else w for k, w in enumerate(base)) for i in range(30)]
    rows += [(90_000 + i, t) for i, t in enumerate(loose)] + [(91_000, "one two"), (91_001, "One  TWO"), (91_002, "one"), (91_003, None), (None, loose[0])]
    want = brute_close(rows)
    got = {(r.a, r.b) for r in simhash.close_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and roots_of(got) == roots_of(want) and (91_001, 91_000) in got
    assert len({i for i in roots_of(got) if 90_000 <= i < 90_030}) == 30


def test_close_links_of_a_passage_shared_by_many(spark):
    """Texts that only share a passage stay apart, and a band of many meets one of them, not all."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"q{i}x{k}" for k in range(40))) for i in range(400)]
    rows += [(1000 + i, t + " end") for i, t in rows[100:200]]
    got = {(r.a, r.b) for r in simhash.close_links(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1000 + i, i) for i in range(100, 200)}


def test_chains_join_up(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 150), (150, 200), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert all(got[i] == 0 for i in range(61)) and got[200] == got[150] == 150


def test_links_of_a_dense_ball(spark):
    fps = [0] + [1 << i for i in range(40)] + [1 << 63]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {r.root for r in simhash.components(links).collect()}
    assert len(roots) == 1


def test_near_dedup_keeps_one(spark):
    out = simhash.near_dedup(docs(spark))
    assert out.columns == docs(spark).columns
    ids = [r.doc_id for r in out.collect()]
    assert 0 in ids and 1004 not in ids and 1000 in ids and 1001 not in ids and None in ids


def test_components_of_stars_chains_cycles_and_hubs(spark):
    """The rounds stop once all links are stars: none are needed for stars, several for chains; the classes match a plain search."""
    import random

    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100, 140)]
    hub = [(999, i) for i in range(200, 260)]  # the hub is the largest of its component
    cases = [[(2, 1), (3, 1), (9, 8)], chain, hub, [(1, 2), (2, 3), (3, 1), (4, 4)], chain + hub + [(120, 230)], [(rng.randrange(300), rng.randrange(300)) for _ in range(150)]]
    for links in cases:
        root = {x: x for link in links for x in link if link[0] != link[1]}
        while any(root[a] != root[b] for a, b in links if a != b):
            for a, b in links:
                if a != b:
                    root[a] = root[b] = min(root[a], root[b])
        got = simhash.components(spark.createDataFrame(links, "a long, b long")).collect()
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.root for r in got} == root
