"""Licence scans and mixing; SQL against all queries that have it."""

import re

import pytest
from cases import docs, none
from compare_rows import same
from pyspark.sql import functions as F

from mirrorloom.llm import license_scan, mixing, queries

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, small, duck, name):
    same(queries.queries()[name](spark, small), duck.sql(queries.oracle_sql()[name]))


def places(text, phrase):
    w, p = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)})), phrase.split()
    return len(w), [i for i in range(len(w)) if w[i : i + len(p)] == p]


def test_licences(spark):
    mit = {label: text for label, text, _ in license_scan.NOTICES}["mit-text"]
    extra = [
        (5000, "Released under the MIT License.\nmit-license and MIT   LICENSE"), (5001, "Licensed under the Apache License, Version 2.0"), (5002, "the license of apache version 2"),
        (5003, "This work is licensed under the GNU General Public License, version 3. MIT license"), (5004, "under the license Licensed under CC BY-NC 4.0 here"),
        (5005, mit.title()), (5006, "MIT"), (5007, "mit" + " license" * 3), (5008, mit.replace("is furnished", "by A. Author 2020 is furnished")), (5009, mit[:200]),
    ]
    df = docs(spark, extra)
    out = license_scan.scan(df)
    got = {r.doc_id: r for r in out.collect()}
    for r in df.collect():
        g = got[r.doc_id]
        found = {label: places(r.text, p) for p, label in license_scan.PHRASES}
        starts = sorted(x for _, xs in found.values() for x in xs)
        assert g.n_words == places(r.text, "x")[0] and g.n_base == len(starts)
        assert (g.first_word, g.last_word) == ((starts[0], starts[-1]) if starts else (None, None))
        assert g.base_labels == ",".join(sorted(k for k, v in found.items() if v[1])) and set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
    assert "mit-notice" in got[5000].labels and got[5001].labels == "apache,apache-2.0" and got[5002].labels == "" and got[5003].labels == "gpl,gpl-3.0,mit"
    assert got[5004].labels == "cc-by-nc-4.0" and got[5005].labels == "mit-grant,mit-text" and got[5005].score == 1.0 and got[5007].n_base == 1
    assert got[5008].labels == "mit-grant,mit-text" and 0.3 < got[5008].score < 1 and got[5009].labels == "mit-grant" and got[5009].score < 0.3
    assert out.count() == df.count() and license_scan.scan(none(spark)).count() == 0


def test_licences_of_files_with_many_notices(spark, duck):
    """A file of all notices, and long ones that repeat them, lose none; the same rows as the SQL."""
    whole = {label: text for label, text, _ in license_scan.NOTICES}
    mixed = ["apache-2.0", "gpl-3.0", "mit-notice", "cc-by-nc-4.0"]
    contents = [whole["mit-notice"] + ". " + whole["mit-text"], ". ".join(whole.values()), ". ".join(whole[k] for k in mixed), whole["mit-notice"], (whole["mit-text"] + " filler words ") * 3, whole["bsd-3-clause"], None, ""]
    rows = [(i, x) for i, x in enumerate(contents)] + [(100 + i, whole["mit-notice"]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: list(filter(None, r.labels.split(","))) for r in license_scan.scan(df).collect()}
    assert got[0] == ["mit", "mit-grant", "mit-notice", "mit-text"] and got[3] == ["mit", "mit-notice"] and got[4] == ["mit-grant", "mit-text"] and got[5] == ["bsd", "bsd-2-clause", "bsd-3-clause"]
    assert got[1] == sorted([*whole, "apache", "gpl", "mit"]) and got[2] == sorted([*mixed, "apache", "gpl", "mit"])
    long = spark.createDataFrame([(1, (whole["mit-text"] + " filler words ") * 300)], "doc_id long, text string")
    assert license_scan.scan(long).first().labels == "mit-grant,mit-text"
    con = duck.cursor()
    con.register("documents_here", df.toPandas())
    con.sql("CREATE TEMP VIEW documents AS SELECT * FROM documents_here")
    same(license_scan.scan(df), con.sql(queries.oracle_sql()["op5_license_scan"]))


def test_mixing_follows_the_weights(spark):
    rows = [(i, "x", "hot" if i % 3 else f"s{i % 7}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {"hot": 1.0, "s0": 2.0, "s3": 1.0}
    out = mixing.mix(df, weights, total=8000).groupBy("source").count().collect()
    got = {r.source: r["count"] for r in out}
    assert set(got) == {"hot", "s0", "s3"} and abs(got["s0"] - 4000) < 300 and abs(got["hot"] - 2000) < 200


def test_mixing_draws_are_poisson(spark):
    for rate in (0.5, 3.0, 40.0):
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
        c = mixing.mix(df, total=4000 * rate).groupBy("doc_id").count()
        s = df.join(c, "doc_id", "left").select(F.coalesce("count", F.lit(0)).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
        assert abs(s[0] - rate) < 4 * (rate / 4000) ** 0.5 and abs(s[1] / rate - 1) < 0.12


def test_mixing_odd_tables(spark):
    df = docs(spark).withColumn("copy", F.lit("own")).withColumn("mix_key", F.lit(1))
    out = mixing.mix(df)
    assert out.columns == [*[c if c not in ("copy", "mix_key") else f"source_{c}" for c in df.columns], "copy", "mix_key"] and out.count() > 50
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    assert mixing.mix(none(spark)).count() == 0 and mixing.mix(df, {"other": 1.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"s0": -1.0})
