"""Language-model scores: the base against brute force, the model's probabilities, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
from cases import docs, none

from mirrorloom.llm import lm_score


def brute(rows):
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b""]
        out.append((str(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)))
    return sorted(out)


def test_base_against_brute_force_with_joined_counts(spark):
    df = docs(spark)
    out = lm_score.score(df, frequent=0.02, steps=20)  # most words meet their counts in the join
    got = sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect())
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def brute_scores(rows, model):
    """The score of each text, token by token, from the model's table and the words' shares of their classes."""
    counts = Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            counts.update((t or "").encode().lower().split())
    top = sorted(counts, key=lambda w: (-counts[w], w))[: lm_score.TOP]
    number = {w: k for k, w in enumerate(top, 1)} | {b"": 0}
    size, kinds = Counter(), Counter()
    for w, c in counts.items():
        if w not in number:
            size[lm_score.class_of(w)] += c
            kinds[lm_score.class_of(w)] += 1
    table, out = model.log_probabilities(), []
    for i, t in rows:
        one = two = 0
        total = 0.0
        for w in (t or "").encode().lower().split() + [b""]:
            k = number.get(w, lm_score.class_of(w))
            total += float(table[two, one, k]) + (math.log10((counts[w] + 0.5) / (size[k] + 0.5 * (kinds[k] + 1))) if w not in number else 0.0)
            two, one = one, k
        out.append((str(i), round(total, 3)))
    return sorted(out)


def test_scores_against_brute_force_for_any_share(spark, small, monkeypatch):
    df = docs(spark)
    models, train = [], lm_score.train
    monkeypatch.setattr(lm_score, "train", lambda *a, **k: models.append(train(*a, **k)) or models[-1])
    for share in (1e-6, 0.02):  # all words are known to the workers, or most meet their counts in the join
        got = sorted((str(r.doc_id), round(r.score, 3)) for r in lm_score.score(df, frequent=share, steps=20).collect())
        assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 0.002 + 1e-5 * abs(b[1]) for a, b in zip(got, brute_scores([(r.doc_id, r.text) for r in df.collect()], models[-1]), strict=True))
    assert models[0].pack() == models[1].pack()


def test_held_out_gain(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    a = lm_score.score(df, steps=100).toPandas().set_index("doc_id").sort_index()
    held = a[a.held_out]
    assert held.score.sum() > held.base_score.sum()
    assert (a.held_out == [zlib.crc32(str(i).encode()) % 5 == 1 for i in a.index]).all()


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    u = np.full(lm_score.OUTCOMES, 1 / lm_score.OUTCOMES)
    model = lm_score.LogBilinear.start(u)
    code = np.unique(rng.integers(0, lm_score.OUTCOMES**3, 2000))
    model = lm_score.train_nce(model, code, np.ones(len(code), np.int64), u, steps=5)
    assert np.allclose((10.0 ** model.log_probabilities()).sum(axis=2), 1, atol=1e-4)


def test_training_learns_a_pattern():
    size = lm_score.OUTCOMES
    u = np.full(size, 1 / size)
    code = np.array([(a * size + b) * size + (b + 1) % 7 for a in range(7) for b in range(7)])  # the next follows from the one before
    model = lm_score.train_nce(lm_score.LogBilinear.start(u), code, np.full(len(code), 10), u, steps=600)
    p = 10.0 ** model.log_probabilities()
    assert all(p[1, b, (b + 1) % 7] > 0.5 for b in range(7))


def test_empty(spark):
    assert lm_score.score(none(spark), steps=5).count() == 0
    one = spark.createDataFrame([(6, "only held out?"), (None, None)], "doc_id long, text string")
    assert lm_score.score(one, steps=5).count() == 2
