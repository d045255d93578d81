"""The pipeline against a plain version of its stages."""

from test_copies import brute_classes, brute_close, roots_of
from test_leaks import brute

import corpus_pipeline
from mirrorloom.llm import mixing, toxicity


def test_pipeline_against_plain_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{small}/labels.parquet"))
    matcher = toxicity.Matcher(model.lexicon())
    left = {r.doc_id: r.text for r in docs.collect() if toxicity.score_hits(matcher.occurrences(r.text), model) < 0.5}
    best = {}
    for i, t in left.items():
        best[t] = max(best.get(t, i), i)
    left = {i: t for i, t in left.items() if best[t] == i}
    links = brute_close(left.items()) | {(i, c) for i, _, c in brute_classes(list(left.items())) if i != c}
    roots = roots_of(links)
    left = {i: t for i, t in left.items() if roots.get(i, i) == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i for i, _, hit, _ in brute(list(left.items()), items) if not hit}
    want = mixing.mix(docs.filter(docs.doc_id.isin(sorted(clean))))
    key = lambda df: sorted((r.doc_id, r.copy, r.mix_key) for r in df.collect())
    out = corpus_pipeline.run(spark, small)
    assert key(out) == key(want)
    assert out.columns[:5] == docs.columns


def test_stages_keep_columns_and_run_on_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(20), small).columns == docs.columns, name
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0, name
