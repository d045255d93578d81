"""Evaluations that train models (pyspark.ml): membership and attribute disclosure, utility, principal components, model selection."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import PCA, Imputer, OneHotEncoder, OneHotEncoderModel, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rng import uniform
from ..written import discard, written
from .cells import predicted
from .compare import closest_risk, correlation_similarity, nearest_record, quality_score, statistical_similarity
from .generate import GENERATORS, _slots, generate
from .privacy import anonymity_level
from .profile import number, unpivot


def _indexers(rows: DataFrame, categorical: list[str]) -> list[StringIndexerModel]:
    """The models of a StringIndexer a column in the order of the alphabet, their labels from one grouping instead of a map that each task fills row by row."""
    labels: dict[str, list[str]] = {c: [] for c in categorical}
    for column, value in unpivot(rows, categorical).dropna().distinct().collect():  # the labels, which a StringIndexer collects as well
        labels[column].append(value)
    return [StringIndexerModel.from_labels(sorted(v), c, f"{c}_ix", "keep") for c, v in labels.items()]


def _features(numeric: list[str], categorical: list[str], rows: DataFrame | None = None) -> list:
    """Stages that make the vector column features: numbers imputed by their mean, categories one-hot, unseen ones apart; those of ``rows`` are all the categories, if it is given."""
    stages: list = []
    if numeric:
        stages.append(Imputer(inputCols=numeric, outputCols=[f"{c}_in" for c in numeric]))
    if categorical:
        index = StringIndexer(inputCols=categorical, outputCols=[f"{c}_ix" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
        stages += [*([index] if rows is None else _indexers(rows, categorical)), OneHotEncoder(inputCols=[f"{c}_ix" for c in categorical], outputCols=[f"{c}_hot" for c in categorical], handleInvalid="keep")]
    return [*stages, VectorAssembler(inputCols=[f"{c}_in" for c in numeric] + [f"{c}_hot" for c in categorical], outputCol="features", handleInvalid="keep")]


def _typed(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    return df.select(*[number(c).alias(c) for c in numeric], *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan")).alias(c) for c in categorical])


def _row_split(df: DataFrame, seed: int, share: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training and test rows, and the written table that both are of: fits read their rows several times, the draws are made once."""
    drawn = written(df.withColumn("trains_", uniform(seed, "split", F.xxhash64(*df.columns)) < share), "split")
    return drawn.filter("trains_").drop("trains_"), drawn.filter("not trains_").drop("trains_"), drawn


def membership_disclosure(original: DataFrame, synthetic: DataFrame, numeric: list[str], categorical: list[str], seed: int = 42) -> DataFrame:
    """One row: auc of a model that tells original from synthetic rows, and risk = 2 |auc - 1/2|."""
    both = _typed(original, numeric, categorical).withColumn("label", F.lit(1.0)).unionByName(_typed(synthetic, numeric, categorical).withColumn("label", F.lit(0.0)))
    train, test, table = _row_split(both, seed)
    # The regression standardises its features by itself (standardization), so they aren't scaled before.
    model = Pipeline(stages=[*_features(numeric, categorical, train), LogisticRegression(maxIter=25, regParam=0.01)]).fit(train)
    auc = BinaryClassificationEvaluator().evaluate(model.transform(test))
    discard(table)
    return original.sparkSession.createDataFrame([(auc, 2 * abs(auc - 0.5))], "auc double, risk double")


#: A forest keeps its training rows in memory or on disk, each with the bin of every feature and a count for every tree; so many bytes of these are one task's.
_FOREST_BYTES = 32 << 20


#: A forest of more draws (rows by trees) is fitted by cell, where its cells are few; up to so many a fit to the rows is quicker.
_FOREST_DRAWS = 1 << 27


def _dealt(rows: DataFrame, n: int, features: int, trees: int) -> DataFrame:
    """n rows in as many partitions as keep what a forest's task holds of them within _FOREST_BYTES; rows that fit into one stay as they are."""
    parts = -(-n * (4 * (features + trees) + 100) // _FOREST_BYTES)
    return rows if parts <= 1 else rows.repartition(max(parts, rows.sparkSession.sparkContext.defaultParallelism))


def _forest_score(judge, rows: DataFrame, test: DataFrame, target: str, numeric: list[str], categorical: list[str], classes: bool, trees: int, seed: int) -> float:
    """The judge's score on test of a forest fitted to the rows. By cell the trees' draws follow the rows alone, else their partitions."""
    index = [StringIndexer(inputCol=target, outputCol="label", handleInvalid="keep", stringOrderType="alphabetAsc")] if classes else []
    features = Pipeline(stages=[*index, *_features(numeric, categorical)]).fit(rows)
    n = rows.count()
    if n * trees > _FOREST_DRAWS:
        # A task holds two sums a cell and tree.
        found = predicted(rows, test, features, numeric, categorical, target, classes, trees, seed, _FOREST_BYTES // (16 * trees))
        if found:
            score = judge.evaluate(found[0])
            discard(*found[1])
            return score
    width = len(numeric) + sum(1 + size for s in features.stages if isinstance(s, OneHotEncoderModel) for size in s.categorySizes)
    kind = RandomForestClassifier if classes else RandomForestRegressor
    forest = kind(numTrees=trees, seed=seed, labelCol="label" if classes else target)
    fitted = forest.fit(features.transform(_dealt(rows, n, width, trees)))
    return judge.evaluate(PipelineModel(stages=[*features.stages, fitted]).transform(test))


def attribute_disclosure(original: DataFrame, synthetic: DataFrame, target: str, numeric: list[str], categorical: list[str], trees: int = 50, seed: int = 42) -> DataFrame:
    """One row: accuracy on the original of a forest trained on the synthetic, baseline (the most frequent value), and risk between them."""
    cols = (numeric, [*categorical, target])
    known, made = _typed(original, *cols), _typed(synthetic, *cols)
    accuracy = _forest_score(MulticlassClassificationEvaluator(metricName="accuracy"), made, known, target, numeric, categorical, True, trees, seed)
    top = known.groupBy(target).count().agg((F.max("count") / F.sum("count")).alias("b")).first()["b"]
    risk = max(0.0, (accuracy - top) / (1 - top)) if top < 1 else 0.0
    return original.sparkSession.createDataFrame([(target, accuracy, top, risk)], "target string, accuracy double, baseline double, risk double")


def attribute_disclosures(original: DataFrame, synthetic: DataFrame, targets: list[str], numeric: list[str], categorical: list[str], trees: int = 50, seed: int = 42) -> DataFrame:
    """target, accuracy, baseline, risk for each sensitive column, each guessed from all other columns."""
    out = None
    for t in targets:
        own = attribute_disclosure(original, synthetic, t, [c for c in numeric if c != t], [c for c in categorical if c != t], trees, seed)
        out = own if out is None else out.unionByName(own)
    return out


def privacy_risk(original: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], categorical: list[str], sensitive: list[str], identifying: list[str], trees: int = 50) -> DataFrame:
    """One row: the risks of near records, membership, attributes (mean over the sensitive columns) and small groups, and their mean."""
    near = closest_risk(nearest_record(original, synthetic, numeric, key), len(numeric)).first()["risk"]
    member = membership_disclosure(original, synthetic, numeric, categorical).first()["risk"]
    guessed = attribute_disclosures(original, synthetic, sensitive, numeric, categorical, trees).agg(F.avg("risk")).first()[0] if sensitive else 0.0
    groups = anonymity_level(synthetic, identifying).first()["risk"] if identifying else 0.0
    parts = [float(x or 0.0) for x in (near, member, guessed, groups)]
    return original.sparkSession.createDataFrame([(*parts, sum(parts) / 4)], "nearest double, membership double, attributes double, groups double, risk double")


def evaluate(original: DataFrame, synthetic: DataFrame, key: str, numeric: list[str], categorical: list[str], target: str, identifying: list[str], sensitive: list[str], trees: int = 50) -> DataFrame:
    """One row: statistical similarity, utility for the target, privacy risk, and the whole: 0.4, 0.4 and 0.2 of (1 - risk)."""
    similar = statistical_similarity(original, synthetic, numeric, categorical).first()["similarity"]
    useful = utility(original, synthetic, target, [c for c in numeric if c != target], [c for c in categorical if c != target], target in categorical, trees).first()["utility"]
    risk = privacy_risk(original, synthetic, key, numeric, categorical, sensitive, identifying, trees).first()["risk"]
    return original.sparkSession.createDataFrame([(similar, useful, risk, 0.4 * similar + 0.4 * useful + 0.2 * (1 - risk))], "similarity double, utility double, risk double, overall double")


def utility(original: DataFrame, synthetic: DataFrame, target: str, numeric: list[str], categorical: list[str], classes: bool, trees: int = 100, seed: int = 42) -> DataFrame:
    """One row: scores on the original's test rows of forests trained on original and on synthetic rows, and their ratio in [0, 1]."""
    cols = (numeric, [*categorical, target]) if classes else ([*numeric, target], categorical)
    train, test, table = _row_split(_typed(original, *cols), seed)
    made = _typed(synthetic, *cols)
    inputs = [c for c in numeric if c != target]
    judge = MulticlassClassificationEvaluator(metricName="accuracy") if classes else RegressionEvaluator(metricName="r2", labelCol=target)
    real, fake = (_forest_score(judge, rows, test, target, inputs, categorical, classes, trees, seed) for rows in (train, made))
    discard(table)
    ratio = min(1.0, max(0.0, fake / real)) if real > 0 else float(fake >= real)
    return original.sparkSession.createDataFrame([(target, real, fake, ratio)], "target string, real double, synthetic double, utility double")


def pca_similarity(original: DataFrame, synthetic: DataFrame, numeric: list[str], most: int = 10) -> DataFrame:
    """One row: rmse between the explained-variance ratios of both sides, standardised by the original, and similarity = 1 - rmse."""
    k = min(most, len(numeric))
    pipe = Pipeline(stages=[*_features(numeric, []), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]).fit(_typed(original, numeric, []))
    ratios = [PCA(k=k, inputCol="scaled", outputCol="p").fit(pipe.transform(_typed(df, numeric, []))).explainedVariance.toArray() for df in (original, synthetic)]
    rmse = float((((ratios[0] - ratios[1]) ** 2).mean()) ** 0.5)
    return original.sparkSession.createDataFrame([(k, rmse, max(0.0, 1 - rmse))], "components int, rmse double, similarity double")


def latent_sample(df: DataFrame, numeric: list[str], n: int, seed: int, components: int = 3) -> DataFrame:
    """row_id and n rows from a linear latent model: principal components with normal scores, projected back; stands for a variational auto-encoder."""
    import numpy as np

    from ..rng import normal

    x = _typed(df, numeric, [])
    pipe = Pipeline(stages=[*_features(numeric, []), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]).fit(x)
    scaler = pipe.stages[-1]
    k = min(components, len(numeric))
    pca = PCA(k=k, inputCol="scaled", outputCol="p").fit(pipe.transform(x))
    axes, share = pca.pc.toArray(), pca.explainedVariance.toArray()
    scale, rest = np.sqrt(share * len(numeric)), np.sqrt(max(0.0, 1 - share.sum()))
    z = [float(s) * normal(seed, f"latent-{i}", F.col("row_id")) for i, s in enumerate(scale)]
    out = _slots(df.sparkSession, n)
    for j, c in enumerate(numeric):
        mixed = sum((float(axes[j, i]) * z[i] for i in range(k)), F.lit(0.0)) + float(rest) * normal(seed, f"rest-{j}", F.col("row_id"))
        out = out.withColumn(c, float(scaler.mean[j]) + float(scaler.std[j]) * mixed)
    return out


def select_generator(df: DataFrame, key: list[str], numeric: list[str], categorical: list[str], methods: tuple[str, ...] = GENERATORS, seed: int = 42) -> DataFrame:
    """method, quality, correlation, score, best: each generator's look-alike against held-out rows; score = their mean."""
    u = uniform(seed, "select", *[F.col(k) for k in key])
    train, test = df.filter(u < 0.8), df.filter(u >= 0.8)
    out = []
    for method in methods:
        made = generate(train, method, key, seed=seed)
        cats = [c for c in categorical if c in made.columns]
        q = quality_score(test, made, numeric, cats).agg(F.avg("score")).first()[0] or 0.0
        r = correlation_similarity(test, made, numeric).first()["similarity"] if len(numeric) > 1 else 1.0
        out.append((method, float(q), float(r), float((q + r) / 2)))
    best = max(out, key=lambda x: x[3])[0]
    return df.sparkSession.createDataFrame([(*x, x[0] == best) for x in out], "method string, quality double, correlation double, score double, best boolean")
