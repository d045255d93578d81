"""Decontamination against brute force."""

import hashlib
import re

import pytest
from cases import docs, none

from mirrorloom.llm import decontaminate, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, items):
    wins = []
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(w))
        wins += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if w and item is not None else []
    out = []
    for doc, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        hit, ids = set(), set()
        for item, win in wins:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    ids.add(item)
        out.append((doc, len(w), len(hit), sorted(ids)))
    return sorted(out, key=str)


def table(spark):
    base = [r.text for r in docs(spark).limit(20).collect()]
    items = [(1, " ".join(base[0].split()[3:20])), (2, base[1].upper()), (3, "amber"), (10, " ".join(base[0].split()[2:9])), (4, None), (5, ""), (None, base[2]), (6, "!!!"), (1, " ".join(base[0].split()[3:20])), (7, "日本 \U0001f600")]
    return spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted([(r.doc_id, r.f.n_words, r.f.n_hit, list(r.f["items"])) for r in df.collect()], key=str)


def test_against_brute_force(spark):
    df, bench = docs(spark), table(spark)
    want = brute([(r.doc_id, r.text) for r in df.collect()], [(r.item_id, r.text) for r in bench.collect()])
    out = decontaminate.find_contamination(df, bench, "f")
    assert out.columns == df.columns + ["f"] and found(out) == want


def test_several_automata_give_the_same(spark):
    df, bench = docs(spark), table(spark)
    one, many = decontaminate.find_contamination(df, bench, "f"), decontaminate.find_contamination(df, bench, "f", max_bytes=1500)
    assert found(one) == found(many)
    spans = lambda d: sorted((str(r.doc_id), [(s.begin, s.end) for s in r.f.spans]) for r in d.collect())
    assert spans(one) == spans(many)


def test_spans_are_in_the_original(spark):
    text = "Before,  the ANSWER: is forty-two! after"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("q", "the answer is FORTY two")], "item_id string, text string")
    (s,) = decontaminate.find_contamination(df, bench, "f").first().f.spans
    assert text[s.begin : s.end] == "the ANSWER: is forty-two"


def test_new_column_is_not_overwritten(spark):
    with pytest.raises(ValueError):
        decontaminate.find_contamination(docs(spark), table(spark), "found")


def test_empty_and_clean(spark):
    df, bench = docs(spark), table(spark)
    assert decontaminate.find_contamination(none(spark), bench, "f").count() == 0
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == df.count()
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and kept.filter("doc_id in (0, 1)").count() == 0 and kept.filter("text is null").count() == 2


def test_query_against_brute_force(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet").collect()
    b = spark.read.parquet(f"{small}/benchmark.parquet").collect()
    ids = lambda x: hashlib.sha256(",".join(x).encode()).hexdigest()
    want = {(x[0], x[1], x[2], len(x[3]), ids(x[3])) for x in brute([(r.doc_id, r.text) for r in d[:60]], [(r.item_id, r.text) for r in b])}
    got = {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in queries.op9_decontamination(spark, small).collect()}
    assert want <= got
