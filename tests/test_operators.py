"""Properties of operators on small tables, against pandas where it has the operation."""

import datetime as dt
import random
import sqlite3
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirrorloom.functions import dates, numeric, strings
from mirrorloom.operators import clean, compare, generate, privacy, profile, relate, schema, validate
from mirrorloom.plans import pipeline
from mirrorloom.rng import integer, normal, uniform
from mirrorloom.sources import readers, writers
from mirrorloom.streaming import profile_stream


def frame(spark, rows, names):
    return spark.createDataFrame(rows, names)


def people(spark, n=300):
    rows = [(i, f"Person {i % 50}", 18 + i % 60, float(i * 7 % 101) + i / 10, "abc"[i % 3], dt.datetime(2020, 1, 1) + dt.timedelta(days=i % 30), dt.datetime(2020, 1, 2) + dt.timedelta(days=i % 30 + i % 5)) for i in range(n)]
    return frame(spark, rows, "id long, full_name string, age int, income double, result string, admit timestamp_ntz, discharge timestamp_ntz")


def test_profile_matches_pandas(spark):
    df = people(spark)
    p = df.select("age", "income").toPandas()
    got = {r.column: r for r in profile.numeric_profile(df, ["age", "income"]).collect()}
    for c in ("age", "income"):
        for k, v in {"mean": p[c].mean(), "std": p[c].std(), "skewness": p[c].skew(), "kurtosis": p[c].kurt(), "q25": p[c].quantile(0.25), "q99": p[c].quantile(0.99)}.items():
            assert got[c][k] == pytest.approx(v, rel=1e-9)


def test_profile_with_nulls_and_nan(spark):
    df = frame(spark, [(1.0, None), (float("nan"), None), (None, None), (3.0, None)], "x double, y double")
    got = {r.column: r for r in profile.numeric_profile(df).collect()}
    assert got["x"]["count"] == 2 and got["x"]["nulls"] == 2 and got["x"]["mean"] == 2.0
    assert got["y"]["count"] == 0 and got["y"]["mean"] is None


def test_spearman_matches_pandas(spark):
    df = people(spark)
    p = df.select("age", "income").toPandas()
    want = p["age"].rank().corr(p["income"].rank())
    assert relate.spearman(df, "age", "income").first()["r"] == pytest.approx(want, abs=1e-9)


def test_ks_is_zero_for_the_same_table(spark):
    df = people(spark)
    r = compare.ks_wasserstein(df, df, "income").first()
    assert r.ks == 0 and r.wasserstein == 0


def test_temporal_relationship_is_found(spark):
    r = relate.temporal_order(people(spark), "admit", "discharge").first()
    assert (r["from"], r["to"], r["consistency"]) == ("admit", "discharge", 1.0)


def test_temporal_repair(spark):
    df = people(spark).withColumn("discharge", F.expr("admit - interval 3 days"))
    fixed = generate.repair_order(df, "admit", "discharge", 1, 5, 1, "id")
    assert fixed.filter("discharge < admit").count() == 0


def test_foreign_keys(spark):
    child = spark.range(100).select((F.col("id") % 20).alias("pk"))
    parent = spark.range(20).select(F.col("id").alias("k"))
    r = relate.foreign_keys({"child": (child, ["pk"]), "parent": (parent, ["k"])}).collect()
    assert [(x.c1, x.c2, x.shared, x.overlap) for x in r] == [("pk", "k", 20, 1.0)]


def test_k_anonymity_holds(spark):
    df = people(spark)
    out = privacy.k_anonymize(df.select("id", "age", "result"), ["age", "result"], 5)
    assert privacy.anonymity_level(out, ["age", "result"]).first().k >= 5


def test_suppression_keeps_null_keys_and_l_diversity_drops_them(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 1), (None, 9)], "q string, s int")
    assert {r.q for r in privacy.suppress_small_groups(df, ["q"], 2).collect()} == {"a", None}
    assert {r.q for r in privacy.l_diverse(df, ["q"], ["s"], 2).collect()} == {"a"}


@pytest.mark.parametrize("level", ["minimal", "balanced", "high"])
def test_anonymize_levels(spark, level):
    df = people(spark).select("id", "age", "result", "income")
    out = privacy.anonymize(df, level, ["age"], ["id"], ["result"], "salt", 1)
    assert out.columns == df.columns and out.filter("length(id) <> 16").count() == 0


@pytest.mark.parametrize("method", generate.GENERATORS)
def test_generators_are_deterministic_under_repartition(spark, method):
    df = people(spark).select("id", "age", "income", "result")
    key = lambda d: sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in d.collect())
    assert key(generate.generate(df, method, ["id"], 200, 7)) == key(generate.generate(df.repartition(5), method, ["id"], 200, 7))


def test_marginals_follow_the_column(spark):
    df = people(spark)
    out = generate.marginals(df, 5000, 3, ["income"], ["result"])
    r = out.agg(F.avg("income").alias("m"), F.avg((F.col("result") == "a").cast("int")).alias("a")).first()
    assert abs(r.m - df.agg(F.avg("income")).first()[0]) < 3 and abs(r.a - 1 / 3) < 0.03


def test_draw_by_position(spark):
    df = frame(spark, [("a",)] * 30 + [("b",)] * 10, "v string")
    counts = profile.value_counts(df, ["v"]).select("value", "n", "total")
    out = generate._draw_by_position(spark.range(2000).withColumnRenamed("id", "row_id"), counts, "v", 5)
    assert out.count() == 2000 and abs(out.filter("v = 'a'").count() / 2000 - 0.75) < 0.05


def test_marginals_of_many_values_keep_all_columns_and_draws(spark):
    df = frame(spark, [(f"name {i % 500:04}", "abc"[i % 3], None if i % 4 else f"é{i % 7}") for i in range(1500)], "name string, value string, third string")
    draw = lambda most: generate.marginals(df, 400, 7, [], df.columns, most)
    whole, parted = draw(100_000), draw(2)
    assert parted.columns == whole.columns == ["row_id", "name", "value", "third"]
    assert sorted(map(tuple, parted.collect())) == sorted(map(tuple, whole.collect()))


def test_copula_keeps_correlation(spark):
    df = people(spark).withColumn("twice", F.col("income") * 2 + F.col("age") * 0.01)
    out = generate.copula(df, 2000, 1, ["income", "twice"])
    assert out.agg(F.corr("income", "twice")).first()[0] > 0.9


def test_shuffle_keeps_the_values(spark):
    df = people(spark).select("id", "full_name")
    out = generate.shuffle_values(df, ["id"], "full_name", 0.5, 1)
    assert sorted(r.full_name for r in out.collect()) == sorted(r.full_name for r in df.collect())
    assert out.join(df.withColumnRenamed("full_name", "old"), "id").filter("full_name <> old").count() > 0


def test_unknown_methods_are_errors(spark):
    df = people(spark)
    with pytest.raises(ValueError):
        generate.generate(df, "ctgan", ["id"])
    with pytest.raises(ValueError):
        generate.mask(df, {"age": "nothing"}, ["id"], 1)
    with pytest.raises(ValueError):
        pipeline.Config(method="x")


@pytest.mark.parametrize("method", [*generate.MASKS, "random_in_range", "random_categorical"])
def test_masks_run(spark, method):
    col = "income" if "numeric" in method or "range" in method else "admit" if "month" in method else "full_name"
    assert generate.mask(people(spark), {col: method}, ["id"], 1).select(col).dropna().count() == 300


def test_names_overlap_little(spark):
    df = people(spark)
    out = generate.mask(df, {"full_name": "random_names"}, ["id"], 1)
    assert out.select("full_name").intersect(df.select("full_name")).count() == 0


def test_random_numbers(spark):
    r = spark.range(5000).select(uniform(1, "a", F.col("id")).alias("u"), normal(1, "b", F.col("id")).alias("z"), integer(3, 5, 1, "c", F.col("id")).alias("i"))
    s = r.agg(F.avg("u"), F.avg("z"), F.stddev("z"), F.min("i"), F.max("i"), F.min("u"), F.max("u")).first()
    assert abs(s[0] - 0.5) < 0.02 and abs(s[1]) < 0.05 and abs(s[2] - 1) < 0.05 and (s[3], s[4]) == (3, 5) and s[5] >= 0 and s[6] < 1


def test_validation(spark):
    df = people(spark)
    C = validate.Constraint
    got = {(r.column, r.kind): r.violations for r in validate.check_constraints(df, [C("age", "range", {"low": 20, "high": 70}), C("id", "unique"), C("result", "unique")]).collect()}
    assert got["id", "unique"] == 0 and got["result", "unique"] == 297 and got["age", "range"] == df.filter("age < 20 or age > 70").count()
    assert validate.check_schema(df, {"id": "bigint", "zip": "string"})[0] == {"column": "zip", "issue": "missing"}
    assert "FOREIGN KEY" in validate.ddl(df, "people", "postgresql", {"id": "other(id)"})


def test_schema(spark):
    s = schema.infer(people(spark))
    assert s.columns["id"].subtype == "id" and s.columns["full_name"].subtype == "name" and s.columns["age"].subtype == "age"
    assert s.columns["admit"].kind == "datetime" and s.columns["result"].kind == "categorical" and s.keys()[0] == "id"
    assert "full_name" in schema.sensitive_columns(people(spark))


def test_cleaning(spark):
    df = frame(spark, [(" a ", "NULL", "1,000"), ("b", "x", "$5"), ("", "N/A", "nan")], ["one\ntwo ", "b", "c"])
    out = clean.clean_frame(df)
    assert out.columns == ["one two", "b", "c"] and out.count() == 2
    assert [r[0] for r in out.select(numeric.coerce(F.col("c"))).collect()] == [1000.0, 5.0]
    assert clean.narrow_types(spark.range(10)).dtypes == [("id", "tinyint")]
    assert clean.preprocess(people(spark).unionByName(people(spark))).count() == 300


def test_strings_and_dates(spark):
    df = frame(spark, [("o'neil-smith x", "12 Oak Street, Salem, NY 10001", "31/12/2020", None)], "n string, a string, d string, e string")
    r = df.select(strings.title_case(F.col("n")).alias("t"), *[c.alias(k) for k, c in strings.parse_address(F.col("a")).items()], dates.parse(F.col("d")).alias("p"), strings.salted_hash(F.col("e"), "s").alias("h"), strings.email_domain_preserved(F.lit("x@y.org"), 1, F.lit(1)).alias("m")).first()
    assert r.t == "O'Neil-Smith X" and (r.house, r.zip, r.state, r.street) == ("12", "10001", "NY", "Oak Street")
    assert r.p == dt.datetime(2020, 12, 31) and len(r.h) == 16 and r.m.endswith("@y.org")


def test_power_transform(spark):
    df = people(spark)
    assert -2 <= numeric.fit_yeo_johnson(df, "income") <= 4


def test_evaluation(spark):
    df = people(spark)
    assert {round(r.score, 6) for r in compare.quality_score(df, df, ["income"], ["result"]).collect()} == {1.0}
    assert compare.categorical_similarity(df, df, ["result"]).first().js == pytest.approx(0, abs=1e-12)
    assert compare.correlation_similarity(df, df, ["age", "income"]).first().similarity == 1.0
    d = compare.nearest_record(df, df.limit(20), ["age", "income"], "id", cell_rows=10)
    assert d.count() == 20 and d.agg(F.max("distance")).first()[0] == pytest.approx(0, abs=1e-9)
    assert 0 < compare.closest_risk(d, 2).first().risk <= 1
    assert compare.audit(compare.exact_overlap(df, df, ["age"])).first().risk == "high"


@pytest.mark.parametrize("kind", ["parquet", "csv", "json", "orc"])
def test_writers_and_readers(spark, tmp_path, kind):
    df = people(spark, 20).select("id", "full_name", "income")
    writers.write({"people": df}, str(tmp_path), kind, manifest={"a": 1})
    got = spark.read.format(kind).option("header", True).load(f"{tmp_path}/people.{kind}")
    assert got.count() == 20


def test_single_files(spark, tmp_path):
    df = people(spark, 20).select("id", "full_name", "income")
    writers.write({"people": df}, f"{tmp_path}/a.db", "sqlite")
    assert sqlite3.connect(f"{tmp_path}/a.db").execute("select count(*) from people").fetchone() == (20,)
    writers.write({"people": df}, f"{tmp_path}/a.zip", "zip")
    assert zipfile.ZipFile(f"{tmp_path}/a.zip").namelist() == ["people.csv"]
    writers.write({"people": df}, f"{tmp_path}/a.xlsx", "xlsx")
    back = readers.read_xlsx(spark, f"{tmp_path}/a.xlsx")["people"]
    assert back.count() == 20 and back.columns == df.columns and back.first()["full_name"] == "Person 0"


def test_csv_folder_and_pipeline(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "people.csv").write_bytes("id,name,age,city\n".encode() + b"".join(f"{i},P{i},{20 + i % 50},{'Köln' if i % 2 else 'NULL'}\n".encode("latin-1") for i in range(60)))
    tables = readers.load(spark, str(src))
    assert tables["people"].filter("city = 'Köln'").count() == 30 and tables["people"].filter("city is null").count() == 30
    result = pipeline.run(spark, str(src), str(tmp_path / "out"), pipeline.Config(method="perturb", keys={"people": ["id"]}, masks={"people": {"name": "random_names"}}))
    assert spark.read.parquet(f"{tmp_path}/out/synthetic_people.parquet").count() == 60
    assert all(0 <= r.score <= 1 for r in result.scores["people"].collect())


def test_empty_table_is_an_error(spark):
    with pytest.raises(ValueError):
        pipeline.run_tables({"t": people(spark).limit(0)}, pipeline.Config(keys={"t": ["id"]}))


def test_streams(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.write.parquet(f"{tmp_path}/in")
    stream = profile_stream.read_stream(spark, f"{tmp_path}/in", events.schema)
    q = profile_stream.windowed_usage(stream).writeStream.format("memory").queryName("usage").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c1").start()
    q.awaitTermination()
    assert spark.table("usage").agg(F.sum("n")).first()[0] == events.count()
    q = profile_stream.profile_batches(stream, lambda b: profile.numeric_profile(b, ["value"]), f"{tmp_path}/out", f"{tmp_path}/c2")
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").agg(F.sum("count")).first()[0] == events.count()


def test_encoding():
    assert readers.encoding_of("é".encode()) == "UTF-8" and readers.encoding_of("Köln und mehr".encode("latin-1")) == "ISO-8859-1" and readers.encoding_of(b"\xff\xfea\x00") == "UTF-16"


def test_pandas_cut_agrees_with_bands(spark):
    ages = list(range(0, 120))
    df = spark.createDataFrame([(a,) for a in ages], "a int")
    got = [r[0] for r in df.select(numeric.life_stage(F.col("a"))).collect()]
    want = pd.cut(ages, [0, 13, 18, 25, 65, 120], right=False, labels=["Child", "Teen", "Young Adult", "Adult", "Senior"]).astype(str).tolist()
    assert got == want


def test_models(spark):
    from mirrorloom.operators import learn

    df = people(spark)
    other = df.withColumn("income", F.col("income") + 500)
    assert learn.membership_disclosure(df, df, ["income"], ["result"]).first().risk < 0.3
    assert learn.membership_disclosure(df, other, ["income"], ["result"]).first().risk > 0.9
    linked = df.withColumn("twin", F.col("result"))
    assert learn.attribute_disclosure(linked, linked, "result", ["income"], ["twin"], trees=5).first().risk > 0.8
    assert learn.utility(df, df, "result", ["income", "age"], [], True, trees=5).first().utility <= 1
    assert learn.pca_similarity(df, df, ["income", "age"]).first().similarity == 1.0
    assert learn.latent_sample(df, ["income", "age"], 100, 1).count() == 100
    r = learn.select_generator(df.select("id", "age", "income", "result"), ["id"], ["age", "income"], ["result"], ("marginals", "perturb"))
    assert r.filter("best").count() == 1


def test_distributions(spark):
    from statistics import NormalDist

    from mirrorloom.operators import distributions
    from mirrorloom.rng import uniform

    base = spark.range(4000)
    bell = base.select((50 + 9 * normal(1, "x", F.col("id"))).alias("v"))
    flat = base.select(uniform(2, "x", F.col("id")).alias("v"))
    decay = base.select((-F.log(1 - uniform(3, "x", F.col("id")))).alias("v"))
    best = lambda df: distributions.fit(df, "v").filter("best").first().family
    assert best(bell) in ("normal", "beta", "weibull") and best(flat) in ("uniform", "beta") and best(decay) in ("exponential", "gamma", "weibull", "beta")
    out = distributions.sample(spark, distributions.fit(bell, "v"), 3000, 5)
    assert out.count() == 3000 and abs(out.agg(F.avg("value")).first()[0] - 50) < 1.5
    assert distributions.fit(bell.limit(3), "v").count() == 0
    ps = [0.0005, 0.02, 0.3, 0.5, 0.77, 0.999]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(distributions.normal_quantile(F.col("p"))).collect()]
    assert all(abs(g - NormalDist().inv_cdf(p)) < 1e-3 for g, p in zip(got, ps))
    z = distributions.normal_scores(people(spark), "income", "z").agg(F.avg("z"), F.stddev("z")).first()
    assert abs(z[0]) < 0.01 and abs(z[1] - 1) < 0.05


def test_schema_repair(spark):
    old = schema.infer(people(spark))
    changed = people(spark).withColumn("age", F.lit("old")).withColumn("zip", F.lit("x"))
    new = schema.repair(changed, old)
    assert new.columns["age"].kind == "categorical" and "zip" in new.columns and new.columns["income"] == old.columns["income"]


def test_marginals_and_swaps_of_many_values(spark):
    from mirrorloom.operators import generate

    df = spark.range(150_000).select("id", F.concat(F.lit("v"), F.col("id")).alias("hi"), F.concat(F.lit("c"), F.col("id") % 3).alias("lo"))
    made = generate.marginals(df, 500, 42, [], ["hi", "lo"])
    assert made.columns == ["row_id", "hi", "lo"] and made.count() == 500 and made.select("lo").distinct().count() == 3
    out = generate.perturb(df, ["id"], 42, 0.3, categories=["hi", "lo"])
    assert out.columns == df.columns and out.count() == 150_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and generate.value_list(df, "hi") is None and generate.value_list(df, "lo") is not None
    changed = out.join(df.select("id", F.col("hi").alias("old")), "id").filter("hi <> old").count()
    assert 0.27 < changed / 150_000 < 0.33


def test_swaps_are_the_same_with_and_without_a_list(spark, monkeypatch):
    from mirrorloom.operators import generate

    df = spark.range(300).select("id", F.concat(F.lit("c"), F.col("id") % 7).alias("c"))
    rows = lambda: sorted(map(tuple, generate.perturb(df, ["id"], 1, 0.5, categories=["c"]).collect()))
    masks = lambda: sorted(map(tuple, generate.mask(df, {"c": "random_categorical"}, ["id"], 1).collect()))
    one, two = rows(), masks()
    monkeypatch.setattr(generate, "HELD_VALUES", 3)
    assert rows() == one and masks() == two


def test_noise_needs_a_row_key(spark):
    from mirrorloom.operators import privacy

    df = spark.range(40).selectExpr("id", "id % 2 as g", "cast(id as double) as x")
    with pytest.raises(ValueError):
        privacy.anonymize(df, "high", ["g"], [], [], "s", 1)
    out = privacy.anonymize(df, "high", ["g"], [], [], "s", 1, row_key=["id"])
    assert out.agg(F.count_distinct(F.round(F.col("x") - F.col("id"), 9))).first()[0] == 40


def test_exact_percentiles(spark):
    import numpy as np

    from mirrorloom.operators.profile import exact_percentiles

    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=5000), 2)
    df = spark.createDataFrame([(float(v), None if i % 2 else float(i % 5)) for i, v in enumerate(x)], "x double, y double").withColumn("z", F.lit(None).cast("double")).repartition(7)
    shares = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    got = {r.column: r.q for r in exact_percentiles(df, {c: F.col(c) for c in "xyz"}, shares).collect()}
    assert np.allclose(got["x"], np.quantile(x, shares)) and np.allclose(got["y"], np.quantile([i % 5 for i in range(0, 5000, 2)], shares)) and got["z"] is None


def test_features_are_undone(spark):
    from mirrorloom.operators import features

    df = spark.range(200).selectExpr("id", "exp(id / 20.0) as skewed", "cast(id % 9 as double) as flat", "case when id % 4 = 0 then null else concat('k', id % 3) end as k")
    fitted = features.fit(df, ["skewed", "flat"], ["k"])
    assert fitted.numbers["skewed"].power is not None and fitted.numbers["flat"].power is None
    made = fitted.transform(df)
    assert abs(made.agg(F.avg("skewed")).first()[0]) < 1e-9 and "k_k0" in made.columns and "k" not in made.columns
    back = fitted.inverse(made).alias("b").join(df.alias("a"), "id")
    high = fitted.numbers["skewed"].high
    assert back.filter(F.abs(F.col("b.skewed") - F.least(F.col("a.skewed"), F.lit(high))) > 1e-6).count() == 0
    assert back.filter("a.k is not null and a.k <> b.k").count() == 0 and back.filter(f"a.k is null and b.k <> '{fitted.fills['k']}'").count() == 0


def test_copied_columns_come_from_one_row(spark):
    from mirrorloom.plans.pipeline import Config, load_config, run_tables

    df = spark.range(120).selectExpr("id", "cast(id * 2 as double) as x", "concat('n', id) as name", "concat('m', id) as mail")
    for method in ("perturb", "marginals"):
        made = run_tables({"t": df}, Config(method=method, keys={"t": ["id"]}, actions={"t": {"name": "copy", "mail": "copy"}})).synthetic["t"]
        assert made.count() == 120 and made.filter("substr(name, 2) <> substr(mail, 2) or name is null").count() == 0
    with pytest.raises(ValueError):
        Config(actions={"t": {"x": "drop"}})
    import json
    import tempfile

    with tempfile.NamedTemporaryFile("w", suffix=".json", delete=False) as f:
        json.dump({"method": "marginals", "constraints": {"t": [{"column": "x", "kind": "not_null"}]}}, f)
    assert load_config(f.name, seed=7).seed == 7 and load_config(f.name).constraints["t"][0].kind == "not_null"


def test_evaluation_weights(spark, small):
    from mirrorloom.plans.queries import QUERIES

    r = QUERIES["table_evaluation"](spark, small).first()
    assert abs(r.overall - (0.4 * r.similarity + 0.4 * r.utility + 0.2 * (1 - r.risk))) < 1e-12 and 0 <= r.risk <= 1


def test_named_dates_and_no_pairs(spark):
    from mirrorloom.operators import discover

    df = spark.range(30).selectExpr("timestamp_seconds(id) as a_time", "timestamp_seconds(id + 86400) as b_time", "timestamp_seconds(id * 2) as start_time")
    assert discover.temporal_orders(df.select("a_time")).count() == 0
    assert {(r["from"], r["to"]) for r in discover.temporal_orders(df).collect()} >= {("a_time", "b_time")}
    assert all("start_time" in (r["from"], r["to"]) for r in discover.temporal_orders(df, named=True).collect())


def _nearest_brute(original, synthetic, columns):
    import numpy as np

    a = np.array([[x or 0.0 for x in r[:columns]] for r in original], float).reshape(-1, columns)
    mean, std = a.mean(axis=0), a.std(axis=0)
    std[std == 0] = 1.0
    z = (a - mean) / std
    return {k: float(np.sqrt((((np.array([x or 0.0 for x in v], float) - mean) / std - z) ** 2).sum(axis=1).min())) for *v, k in synthetic}


def test_rows_of_a_forest_are_dealt_to_bounded_tasks(spark, monkeypatch):
    from mirrorloom.operators import learn

    df = frame(spark, [(float(i % 50), "ab"[i % 2], float(i % 50 + i % 3)) for i in range(4000)], "a double, b string, y double").coalesce(1)
    seen = []
    fit = learn.RandomForestRegressor.fit
    monkeypatch.setattr(learn.RandomForestRegressor, "fit", lambda self, rows: seen.append(rows.rdd.glom().map(len).collect()) or fit(self, rows))
    whole = learn.utility(df, df, "y", ["a"], ["b"], False, trees=5).first()
    monkeypatch.setattr(learn, "_FOREST_BYTES", 20_000)
    parted = learn.utility(df, df, "y", ["a"], ["b"], False, trees=5).first()
    assert [len(s) for s in seen[:2]] == [1, 1]
    assert all(sum(s) == sum(w) and max(s) * (4 * 9 + 100) <= 2 * 20_000 for s, w in zip(seen[2:], seen[:2]))
    assert whole.real > 0.5 and abs(whole.real - parted.real) < 0.2


def test_labels_of_one_grouping_are_those_of_the_indexer(spark):
    from mirrorloom.operators import learn

    df = frame(spark, [(v, w) for v, w in zip(["b", "a", "é", "b", "\U0001f600", "\uffee", ""], ["x", None, "y", "x", "z", "x", "w"])], "v string, w string")
    known = df.dropna()
    fitted = learn._features([], ["v", "w"])[0].fit(known)
    assert [list(m.labels) for m in learn._indexers(known, ["v", "w"])] == [list(a) for a in fitted.labelsArray]


def test_split_rows_are_drawn_once(spark, monkeypatch):
    from mirrorloom.operators import learn

    df = people(spark)
    calls, draw = [], learn.uniform
    monkeypatch.setattr(learn, "uniform", lambda *a: calls.append(1) or draw(*a))
    train, test, table = learn._row_split(df, 3)
    u = draw(3, "split", F.xxhash64(*df.columns))
    assert sorted(map(str, train.collect())) == sorted(map(str, df.filter(u < 0.8).collect()))
    assert sorted(map(str, test.collect())) == sorted(map(str, df.filter(u >= 0.8).collect()))
    assert len(calls) == 1 and "sha2" not in train._jdf.queryExecution().toString()


def test_nearest_record_opens_few_of_many_boxes(monkeypatch):
    import numpy as np

    cells = 4096
    low, high = np.zeros((2 * cells, 2)), np.ones((2 * cells, 2))
    low[cells:, 0], high[cells:, 0] = np.arange(cells), np.arange(cells) + 0.5
    for i in range(cells - 1, 0, -1):
        low[i], high[i] = np.minimum(low[2 * i], low[2 * i + 1]), np.maximum(high[2 * i], high[2 * i + 1])
    tree, opened, bound = compare._Tree(cells, low, high), [], compare._Tree.bound
    monkeypatch.setattr(compare._Tree, "bound", lambda self, x, node: opened.append(len(node)) or bound(self, x, node))
    x = np.random.default_rng(1).uniform([0, -1], [cells, 2], (500, 2))
    d = np.full(500, 4.0)
    assert (abs(low[tree.nearest(x), 0] - x[:, 0]) < 2).all()
    row, cell, _ = tree.within(x, d)
    gap = np.maximum(np.maximum(low[None, cells:] - x[:, None], x[:, None] - high[None, cells:]), 0)
    want = np.nonzero((gap * gap).sum(2) < 4.0)
    assert sorted(zip(row, cell - cells)) == sorted(zip(*want))
    assert sum(opened) < 500 * 100  # all boxes are 500 * 4096


@pytest.mark.parametrize("columns, cell_rows, most_cells", [(2, 4, 64), (3, 8, 65_536), (5, 3, 7), (3, 10_000, 65_536)])
def test_nearest_record_against_all_pairs(spark, columns, cell_rows, most_cells):
    """Clumps, a hot original and a hot synthetic row, far outliers, nulls, a column without spread."""
    rng = random.Random(columns)
    names = [f"x{i}" for i in range(columns)]
    row = lambda: [round(rng.choice((0, 5, 40)) + rng.gauss(0, 1), 2) if rng.random() > 0.05 else None for _ in range(columns - 1)] + [3.0]
    original = [row() for _ in range(300)] + [[1.0] * columns] * 150
    synthetic = [[*row(), i] for i in range(150)] + [[*([2.0] * columns), 1000 + i] for i in range(80)] + [[*([9e5] * columns), 2000], [*([None] * columns), 2001]]
    kind = ", ".join(f"{c} double" for c in names)
    a, b = spark.createDataFrame(original, kind), spark.createDataFrame(synthetic, f"{kind}, id long")
    got = compare.nearest_record(a, b, names, "id", cell_rows, most_cells)
    want = _nearest_brute(original, synthetic, columns)
    rows = {r.id: r.distance for r in got.collect()}
    assert len(rows) == len(synthetic) and all(rows[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in want.items())
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert compare.nearest_record(a, b.limit(0), names, "id").count() == 0
    assert {r.distance for r in compare.nearest_record(a.limit(0), b.limit(3), names, "id").collect()} == {None}


def test_grouped_percentiles_against_sorted_lists(spark):
    """A hot group with a third of the rows, one value that repeats, nulls as group and as value, a group of one, clashing names."""
    rng = random.Random(4)
    rows = [(f"g{rng.randint(0, 9)}" if rng.random() > 0.1 else None, rng.choice((None, 1.5, rng.gauss(0, 9)))) for _ in range(600)]
    rows += [("hot", rng.choice((7.0, rng.gauss(0, 1)))) for _ in range(300)] + [("one", 2.0), ("none", None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "g string, v double, n int, key_ string")
    shares = [0.0, 0.1, 0.5, 0.77, 1.0]
    want = {}
    for g, v in rows:
        if v is not None:
            want.setdefault(g, []).append(v)
    got = {r.g: r for r in profile.grouped_percentiles(df, ["g"], F.col("v"), shares).collect()}
    assert set(got) == set(want)
    for g, values in want.items():
        values.sort()
        cut = [values[int(p * (len(values) - 1))] + (values[-int(-p * (len(values) - 1) // 1)] - values[int(p * (len(values) - 1))]) * (p * (len(values) - 1) % 1) for p in shares]
        assert (got[g].n, got[g].min, got[g].max) == (len(values), values[0], values[-1])
        assert got[g]["mean"] == pytest.approx(sum(values) / len(values)) and list(got[g].q) == pytest.approx(cut)
    out = profile.grouped_percentiles(df, ["g"], F.col("v"), [0.5])
    assert "percentile" not in out._jdf.queryExecution().toString() and profile.grouped_percentiles(df.limit(0), ["g"], F.col("v"), [0.5]).count() == 0
    assert {r.g for r in profile.group_stats(df, "g", F.col("v"), least=2).collect()} == set(want) - {"one"}


def test_privacy_budget(spark):
    budget = privacy.Budget(1.0)
    df = people(spark)
    privacy.private_mean(df, "income", 0, 100_000, 0.3, 1, budget)
    privacy.private_histogram(df, "age", 0.2, 1, budget=budget)
    assert budget.spent == pytest.approx(0.5) and budget.left == pytest.approx(0.5)
    for part, epsilon in (("a", 0.4), ("b", 0.3), ("b", 0.1)):
        budget.draw(epsilon, "count", "city", part)
    assert budget.spent == pytest.approx(0.9)  # parts that share no rows cost the largest
    with pytest.raises(privacy.BudgetExceeded):
        budget.draw(0.2, "count")
    assert budget.spent == pytest.approx(0.9) and len(budget.draws) == 5
    with pytest.raises(privacy.BudgetExceeded):
        privacy.private_means(df, {"age": (0, 100), "income": (0, 100_000)}, 1.0, 1, budget=budget)
    assert [round(r.spent, 6) for r in privacy.Budget.report(budget, spark).collect()][:5] == [0.3, 0.5, 0.9, 0.9, 0.9]
    with pytest.raises(ValueError):
        privacy.Budget(0)


def test_private_means(spark):
    rows = [(g, v) for g in ("x", None) for v in [5.0] * 4000 + [-1e9, None]] + [("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in privacy.private_means(df, {"v": (0, 10)}, 5.0, 3, "g").collect()}
    assert set(got) == {"x", None, "empty"} and got["empty"].private_mean is None and got["empty"].n == 0
    assert all(got[g].n == 4001 and got[g].private_mean == pytest.approx(5.0, abs=0.05) for g in ("x", None))


def test_normal_quantile_matches_the_standard_library(spark):
    from statistics import NormalDist

    import numpy as np

    from mirrorloom.functions import normal as gauss

    ps = [1e-300, 1e-12, 0.001, 0.0749, 0.3, 0.5, 0.8, 0.9999, 1 - 1e-12]
    want = [NormalDist().inv_cdf(p) for p in ps]
    got = spark.createDataFrame([(i, p) for i, p in enumerate([*ps, 0.0, 1.0, None])], "i int, p double").orderBy("i").select(gauss.quantile(F.col("p"))).collect()
    assert [r[0] for r in got[:-3]] == pytest.approx(want, rel=1e-12) and [r[0] for r in got[-3:]] == [None] * 3
    assert list(gauss.quantiles(np.array(ps))) == pytest.approx(want, rel=1e-12)


def hidden(spark, rows=20_000):
    """Columns cut from normal numbers of known correlations, with nulls as their lowest part."""
    import numpy as np

    want = np.array([[1, 0.6, -0.5, 0.3], [0.6, 1, -0.4, 0.2], [-0.5, -0.4, 1, 0.0], [0.3, 0.2, 0.0, 1]])
    z = np.random.default_rng(5).multivariate_normal(np.zeros(4), want, rows)
    table = pd.DataFrame({"income": np.exp(z[:, 0]), "grade": np.where(z[:, 1] < 0.3, "a", np.where(z[:, 1] < 1.0, "b", "c")), "flag": z[:, 2] > 0.5, "day": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.round(z[:, 3] * 100), unit="D")})
    table.loc[z[:, 0] < -0.8, "income"] = None
    table["day"] = table["day"].dt.date
    return spark.createDataFrame(table, "income double, grade string, flag boolean, day date").withColumn("income", F.expr("nullif(income, double('NaN'))")), want


def test_copula_of_mixed_columns_finds_and_keeps_hidden_correlations(spark):
    import numpy as np

    from mirrorloom.operators import copula

    df, want = hidden(spark)
    model = copula.fit(df, df.columns)
    assert np.abs(model.correlations - want).max() < 0.04
    made = copula.sample(model, 20_000, 3)
    assert [f.dataType for f in made.drop("row_id").schema] == [f.dataType for f in df.schema]
    shares = lambda t: t.agg(F.avg(F.col("income").isNull().cast("int")), *[F.avg((F.col("grade") == g).cast("int")) for g in "abc"], F.avg(F.col("flag").cast("int")), F.median("income") / 10, F.median(F.unix_date("day")) / 10_000).first()
    assert list(shares(made)) == pytest.approx(list(shares(df)), abs=0.015)
    assert np.abs(copula.fit(made, df.columns).correlations - want).max() < 0.05
    copula.release(model)


def test_copula_jobs_do_not_grow_with_pairs(spark):
    from mirrorloom.operators import copula

    df = spark.range(200).select(*[(F.col("id") * (i + 3) % 17).alias(f"c{i}") for i in range(8)])
    used = []
    for size in (2, 8):
        spark.sparkContext.setJobGroup(f"copula-{size}", "")
        copula.fit(df, df.columns[:size])
        used.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"copula-{size}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert used[0] == used[1]


def test_copula_edge_cases(spark):
    schema = "x double, s string, t timestamp_ntz, k int"
    empty = generate.copula(frame(spark, [], schema), 3, 1, ["x", "s", "t", "k"])
    assert [tuple(r)[1:] for r in empty.collect()] == [(None,) * 4] * 3
    same = generate.copula(frame(spark, [(float("nan"), None, dt.datetime(2020, 1, 1), 7)] * 4, schema), 3, 1, ["x", "s", "t", "k"])
    assert [tuple(r)[1:] for r in same.collect()] == [(None, None, dt.datetime(2020, 1, 1), 7)] * 3
    with pytest.raises(ValueError):
        generate.copula(spark.sql("SELECT array(1) AS a"), 3, 1, ["a"])


def test_kernel_density_matches_a_plain_sum_and_its_sampler(spark):
    import numpy as np

    from mirrorloom.operators import distributions

    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, 600), rng.normal(9, 0.5, 300), [40.0, 40.0]])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)] + [(-1, None), (-2, float("inf")), (-3, float("nan"))], "id long, x double")
    got = distributions.kernel_density(df, "x").orderBy("x").toPandas()
    h = 0.2 * x.std(ddof=1)
    at = np.linspace(x.min() - 3 * h, x.max() + 3 * h, 101)
    plain = np.exp(-(((at[:, None] - x) / h) ** 2) / 2).sum(1) / (len(x) * h * np.sqrt(2 * np.pi))
    assert got.x.to_numpy() == pytest.approx(at) and np.abs(got.density - plain).max() < 2e-4 * plain.max()
    made = np.sort([r.value for r in distributions.sample_density(df, "x", 20_000, 7).collect()])
    assert len(made) == 20_000
    step = at[1] - at[0]
    below = np.cumsum(plain) * step - plain * step / 2
    assert np.abs(np.searchsorted(made, at) / len(made) - below).max() < 0.02
    assert distributions.kernel_density(df.filter("x = 40"), "x").count() == 0 and distributions.kernel_density(df.limit(0), "x").count() == 0
    assert {r.value for r in distributions.sample_density(df.filter("x = 40"), "x", 5, 7).collect()} == {40.0}
    assert distributions.sample_density(df.limit(0), "x", 5, 7).count() == 0


def test_categories_drawn_by_either_way(spark):
    from mirrorloom.operators import distributions

    df = frame(spark, [(c,) for c in "aaaaaabbbc"] + [(None,)] * 5, "s string")
    few, many = [sorted(map(tuple, distributions.sample_categories(df, "s", 3000, 1, most).collect())) for most in (100, 1)]
    assert few == many
    shares = pd.Series([v for _, v in few]).value_counts(normalize=True)
    assert [shares[c] for c in "abc"] == pytest.approx([0.6, 0.3, 0.1], abs=0.03)
    assert {r.value for r in distributions.sample_categories(df.filter("s IS NULL"), "s", 3, 1).collect()} == {None}
    assert distributions.resample(df, "s", 10, 1).count() == 10
    numbers = spark.range(5).select("id", (F.col("id") * 1.5).alias("x"))
    assert distributions.resample(numbers, "x", 10, 1).count() == 10


def test_information_matrix(spark):
    import math

    rows = [(i % 4, float(i % 4), "xy"[i % 2], None) for i in range(400)] + [(None, float("nan"), "x", None)]
    got = {(r.a, r.b): (r.n, r.mi) for r in relate.information_matrix(frame(spark, rows, "k int, d double, s string, e string"), ["k", "d", "s", "e"], 4).collect()}
    assert got["k", "d"] == (400, pytest.approx(math.log(4))) and got["k", "s"] == (400, pytest.approx(math.log(2)))
    assert got["k", "e"] == (0, None) and len(got) == 6
    assert relate.information_matrix(frame(spark, [], "k int, s string"), ["k", "s"]).collect()[0].mi is None


def _scattered(spark, n=4000, seed=5):
    import numpy as np

    r = np.random.default_rng(seed)
    a, c = r.integers(0, 50, n), r.normal(0, 3, n)
    b = np.array(["x", "y", "z", None], dtype=object)[r.integers(0, 4, n)]
    y = a + 5 * (b == "x") + c + r.normal(0, 2, n)
    kind = np.where(y > 30, "high", np.where(y > 12, "mid", "low"))
    rows = [(None if i % 40 == 3 else float(v), w, float(x), float(t), str(k)) for i, (v, w, x, t, k) in enumerate(zip(a, b, c, y, kind))]
    return frame(spark, rows, "a double, b string, c double, y double, kind string")


def test_forest_by_cell_scores_as_the_one_by_row(spark, monkeypatch):
    from mirrorloom.operators import cells, learn

    df = _scattered(spark)
    other = _scattered(spark, seed=6).withColumn("b", F.expr("if(b = 'y', 'new', b)"))
    fits, score = [], []
    fit = cells.RandomForestRegressor.fit
    monkeypatch.setattr(cells.RandomForestRegressor, "fit", lambda self, rows: fits.append(rows.agg(F.count("*"), F.sum("w") if "w" in rows.columns else F.lit(None)).first()) or fit(self, rows))
    for draws in (learn._FOREST_DRAWS, 0):
        monkeypatch.setattr(learn, "_FOREST_DRAWS", draws)
        score.append([*learn.utility(df, other, "y", ["a"], [], False, trees=10).first()[1:3], learn.attribute_disclosure(df, other, "kind", ["a", "c"], ["b"], 10).first().accuracy])
    assert min(score[0]) > 0.5 and all(abs(x - y) < most for x, y, most in zip(*score, (0.02, 0.02, 0.1)))
    # A tree of the forest by cell reads cells (50 values and the mean in place of nulls), and the draws of all rows.
    assert len(fits) == 2 + 2 * 10 and all(n <= 51 and abs(drawn / (4000 if i >= 10 else 3200) - 1) < 0.1 for i, (n, drawn) in enumerate(fits[2:]))


def _drawn(spark, rows, trees):
    import numpy as np

    from mirrorloom.operators import cells

    keys = rows.select("i", F.xxhash64("i").alias("key")).orderBy("i").toPandas()
    k = cells.draws(keys["key"].to_numpy(), np.ones(len(keys), dtype=int), trees)
    return rows.join(frame(spark, [(int(i), *map(float, w)) for i, w in zip(keys["i"], k)], "i long, " + ", ".join(f"w{t} double" for t in range(trees))), "i").cache()


def test_a_tree_of_the_sums_of_cells_is_that_of_the_rows(spark, monkeypatch):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer, VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from mirrorloom.operators import cells

    rows = frame(spark, [(i, float(i % 7), float(i % 4), (i % 28) * 3 + i * 13 % 97 / 7, "pqr"[(i % 28 + i * 11 % 17) // 15]) for i in range(2000)], "i long, a double, b double, y double, c string")
    rows = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    named = StringIndexer(inputCol="c", outputCol="label").fit(rows).transform(rows)
    # A node of one cell is a leaf at once, a node of its rows asks first; so that all later draws of features agree, no features are drawn for numbers.
    monkeypatch.setattr(cells, "RandomForestRegressor", lambda **k: RandomForestRegressor(**(k | {"featureSubsetStrategy": "all"})))
    for classes, kind, some, out, labelled in ((False, RandomForestRegressor, "all", "predictionCol", rows.withColumn("label", F.col("y"))), (True, RandomForestClassifier, "sqrt", "probabilityCol", named)):
        drawn = _drawn(spark, labelled, 3)
        bags = drawn.groupBy("a", "b", *["label"] * classes).agg(F.first("features").alias("features"), *[F.sum(f"w{t}").alias(f"w{t}") for t in range(3)], *[F.sum(F.col(f"w{t}") * F.col("label")).alias(f"s{t}") for t in range(3)])
        for t, tree in enumerate(cells._fitted(bags, labelled.schema["label"].metadata, classes, 3, 9)):
            whole = kind(numTrees=1, bootstrap=False, featureSubsetStrategy=some, weightCol=f"w{t}", seed=tree.getSeed(), **{out: "whole"}).fit(drawn.filter(F.col(f"w{t}") > 0))
            both = tree.transform(whole.transform(drawn).drop("prediction", "rawPrediction")).select("whole", f"tree{t}").distinct().collect()
            assert len(both) > 5 and all((abs(x - y) if not classes else max(map(abs, x.toArray() - y.toArray()))) < 1e-6 for x, y in both)
        drawn.unpersist()


def test_draws_by_cell_are_poisson_whatever_the_partitions(spark, monkeypatch):
    import numpy as np

    from mirrorloom.operators import cells, learn

    key = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, size=5000)
    for mean in (1, 60, 10**8):
        k = cells.draws(key, np.full(5000, mean), 20)
        assert abs(k.mean() / mean - 1) < 5 / (mean * k.size) ** 0.5 and abs(k.var() / mean - 1) < 0.03 and k.min() >= 0
        assert abs(np.corrcoef(k[:, 0], k[:, 1])[0, 1]) < 0.07
    mixed = cells.draws(key[:3], np.array([60, 1, 60]), 20)
    assert (mixed == np.vstack([cells.draws(key[i : i + 1], np.array([n]), 20) for i, n in enumerate((60, 1, 60))])).all()
    monkeypatch.setattr(learn, "_FOREST_DRAWS", 0)
    df = _scattered(spark, 1000)
    found = [learn.utility(rows, rows, "y", ["a"], ["b"], False, trees=3).first() for rows in (df, df.repartition(5, "y"))]
    assert all(abs(x - y) < 1e-9 for x, y in zip(found[0][1:], found[1][1:]))


def test_bins_of_a_forest_keep_few_values_and_heavy_ones(spark):
    from mirrorloom.operators import cells

    df = frame(spark, [(float(i % 3), 7.0, 0.0 if i % 2 else float(i), float("inf") if i % 5 == 0 else 1.0) for i in range(2000)], "few double, one double, heavy double, ends double")
    few, one, heavy, ends = cells.edges(df, ["few", "one", "heavy", "ends"])
    assert [round(x, 9) for x in few] == [0.5, 1.5] and one == [] and len(ends) == 1 and 1 < ends[0] < 1.1
    assert 0 < heavy[0] < 1e-300 or heavy[:1] == [0.0] and 0 < heavy[1] < 1e-300
    assert 14 <= len(heavy) <= 31


def test_forest_of_too_many_cells_is_fitted_to_the_rows(spark, monkeypatch):
    from mirrorloom.operators import learn

    df = _scattered(spark, 500)
    want = learn.utility(df, df, "y", ["a", "c"], ["b"], False, trees=3).first()
    monkeypatch.setattr(learn, "_FOREST_DRAWS", 0)
    fewest = learn.predicted
    monkeypatch.setattr(learn, "predicted", lambda *a: fewest(*a[:-1], 20))
    assert learn.utility(df, df, "y", ["a", "c"], ["b"], False, trees=3).first() == want
