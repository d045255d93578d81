"""Toxicity: the automaton against edit distances, held-out accuracy, contexts, odd tables."""

import itertools
import random
from collections import Counter

import pytest
from cases import docs, none, texts
from pyspark.sql import functions as F

from mirrorloom.llm import queries, toxicity
from mirrorloom.llm.common import fold


def distance(a, b):
    """Edits with swaps of neighbours."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_against_edit_distance():
    words = "idiot moron stupid trash clown worthless".split()
    lexicon = toxicity.Lexicon(words, ["lowei"])
    tries = set()
    for w in words:
        for i in range(len(w) + 1):
            tries |= {w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "q" + w[i + 1 :], w[: i - 1] + w[i : i + 1] + w[i - 1 : i] + w[i + 1 :] if i else w}
    for t in tries:
        near = sorted(w for w in words if distance(t, w) == 1)
        assert lexicon.near(t) == near
        found = lexicon.find(t)
        if t not in words and len(t) >= 5:
            assert (found[0] if found else None) == (near[0] if near else None), t
    assert lexicon.find("loweischaft") == ("lowei", "stem") and lexicon.find("lowei") is None and lexicon.find("idio") is None


def test_quotation_scores_lower():
    model = toxicity.Model({("idiot", "word"): 6.0, ("idiot", "near"): 4.0})
    m = toxicity.Matcher(model.lexicon())
    score = lambda t: toxicity.score_hits(m.occurrences(t), model)
    assert score("you are an idiot here") > score("this is an idiot thing") > 0.5 > score('he said the word "idiot" is old') > score("nothing at all")
    assert score("you iidot") > 0.5
    assert score(None) == score("")


PARTS = {"whole": (), "no near": ("near",), "no context": ("context",), "neither": ("near", "context")}


def cross_validate(spark, folder, folds):
    """For each variant the toxic and other documents of the folds, and how many of either are marked; fold 0 is never looked at."""
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    out = {name: Counter() for name in PARTS}
    for k in folds:
        model = toxicity.fit(docs, labels.filter(fold(F.col("doc_id")) != k))
        left = docs.join(labels.select("doc_id", "toxic"), "doc_id").filter((fold(F.col("doc_id")) == k) & F.col("toxic").isin(0, 1)).select("doc_id", "text", "toxic").cache()
        for name, parts in PARTS.items():
            for r in toxicity.score(left, model.without(*parts), to="s").groupBy("toxic").agg(F.count("*").alias("n"), F.sum((F.col("s") >= 0.5).cast("int")).alias("marked")).collect():
                out[name].update({("toxic" if r.toxic else "others", "all"): r.n, ("toxic" if r.toxic else "others", "marked"): r.marked})
        left.unpersist()
    return out


def test_each_part_earns_its_place(spark):
    got = cross_validate(spark, "/root/testdata/sf0.1", (1, 2))
    errors = {name: c["toxic", "all"] - c["toxic", "marked"] + c["others", "marked"] for name, c in got.items()}
    c = got["whole"]
    assert c["toxic", "marked"] > 0.85 * c["toxic", "all"] and c["others", "marked"] < 0.05 * c["others", "all"]
    assert errors["whole"] <= min(errors.values())


def planted(spark):
    """Prose in which toxic documents hold one of three terms, some misspelled, and clean ones quote them."""
    rng, prose = random.Random(4), texts(900, seed=8)
    terms = ["grumbolt", "snarvik", "plodwick"]

    def wrong(w):
        i, c = rng.randrange(3), rng.choice("abcdefhijkmnoqtuvwxyz")  # none of the first letters
        return rng.choice([w[:i] + c + w[i + 1 :], w[:i] + c + w[i:]])

    rows = []
    for i, t in enumerate(prose):
        term = terms[i % 3]
        kind = "clean" if i < 585 else "quoted" if i < 600 else "wrong" if i < 700 else "toxic"
        said = {"clean": "you", "quoted": f'you and they said the word "{term}" is old', "wrong": f"you {wrong(term)}", "toxic": f"you {term}"}[kind]
        rows.append((i, f"{t} {said} {t[::-1]}", int(kind in ("wrong", "toxic")), kind))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int, kind string")


def test_misspellings_need_the_automaton_and_quotations_the_context(spark):
    df = planted(spark)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    held = df.filter(fold(F.col("doc_id")) == 0)
    share = {}
    for name, parts in PARTS.items():
        for r in toxicity.score(held, model.without(*parts), to="s").groupBy("kind").agg(F.avg((F.col("s") >= 0.5).cast("int")).alias("m")).collect():
            share[name, r.kind] = r.m
    assert share["whole", "wrong"] > 0.9 and share["no near", "wrong"] == 0
    assert share["whole", "toxic"] == 1 and share["whole", "clean"] == share["whole", "quoted"] == 0 and share["no context", "quoted"] > 0.9


def test_new_column_is_not_overwritten(spark):
    with pytest.raises(ValueError):
        toxicity.score(docs(spark), toxicity.Model(), to="Found")


def test_long_words_are_no_terms(spark):
    word = "x" * 2000
    rows = [(i, f"{word} {t}" if i < 60 else t) for i, t in enumerate(texts(200, seed=6))]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 60)) for i in range(200)], "doc_id long, toxic int"))
    assert all(len(t) <= toxicity.LONGEST for t, _ in model.weights)
    matcher = toxicity.Matcher(toxicity.Lexicon(["y" * toxicity.LONGEST], []))
    assert matcher.occurrences(f"{word} {'y' * (toxicity.LONGEST + 1)}")[0][1] == "near"


def test_odd_tables(spark):
    prose = texts(220, seed=9)
    df = docs(spark, [(5000 + i, t) for i, t in enumerate(prose[:160])] + [(6000 + i, f"you idiot {t} stupid") for i, t in enumerate(prose[160:])])
    labels = spark.createDataFrame([(i, 0) for i in range(5000, 5160)] + [(i, 1) for i in range(6000, 6060)] + [(None, 1), (5000, None), (6000, 7), (6001, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    out = toxicity.score(df, model, to="s")
    assert out.columns == df.columns + ["s"] and out.count() == df.count()
    held = out.filter(fold(F.col("doc_id")) == 0)
    assert held.filter("doc_id >= 6000 and s < 0.5").count() == 0 and held.filter("doc_id < 6000 and s >= 0.5").count() == 0
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and kept.filter("text is null").count() == 2
    assert toxicity.score(none(spark), model).count() == 0
    assert toxicity.fit(df, labels.limit(0)).weights == {} and toxicity.fit(none(spark), labels).weights == {}


def test_dense_stems():
    two = Counter({("abc", "abcd"): 1, ("abc", "abce"): 1, ("xyz", "xyzd"): 9})
    assert toxicity.dense_stems(two, 2 * toxicity.DENSE) == {"abc"}
    assert toxicity.dense_stems(two, 2 * toxicity.DENSE + 1) == set()
    assert toxicity.dense_stems(Counter(), 0) == set()
    matcher = toxicity.Matcher(toxicity.Lexicon([], ["uvw"], ["abc"]))
    assert matcher.occurrences("so abcd is") == []
    assert matcher.occurrences("so abcd abcd is") == []
    assert matcher.occurrences("so abcd abce uvwx") == [("abc", "dense", "plain"), ("abc", "dense", "plain"), ("uvw", "stem", "plain")]


def test_near_copies_count_once(spark):
    words = " ".join(f"word{i}" for i in range(80))
    rows = [(1, 1, words), (2, 1, words + " more"), (3, 0, "others " * 9), (4, 0, ""), (5, 0, words.replace("word40", "new")), (6, 1, " ".join(f"own{i}" for i in range(80)))]
    train = spark.createDataFrame([(*r, toxicity._signatures(r[2])) for r in rows], "i int, y int, t string, s array<long>")
    kept = {(r.y, r.t) for r in toxicity._distinct(train).collect()}
    assert kept == {(r[1], r[2]) for r in rows if r[0] in (1, 3, 4, 6)}
    assert toxicity._distinct(train.limit(0)).count() == 0
