"""The queries of the operators, with their contracts' columns, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, exact_dedup, html_extract, license_scan, lm_score, mixing, secret_scan, simhash, token_count, toxicity, url_filter, vector_codes
from .common import fold, table

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), to="score")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_count.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("found.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.n_hit") > 0).alias("contaminated"),
    )


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list: canonical URLs of all addresses that carry a referrer tag; the other addresses of those pages are found by it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    tagged = pages.filter(F.col("url").rlike(r"[?&]ref="))
    listed = tagged.select(url_filter.canonical(url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))).alias("key"))
    return url_filter.filter_urls(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), to="secrets")
    of = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long")
    spans = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("secrets", lambda s: s.kind.isin(*secret_scan.BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in secret_scan.BASE], F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("secrets")).alias("spans"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"), keep=("label",))
    whole = vector_codes.summed_over(coded, "label", "error", "label_error")
    return whole.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


_OP4 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

def _op5() -> str:
    """The SQL of the licence scan: every place of every anchor is verified, without an index; the notices and phrases as values."""
    rows = lambda xs: ", ".join(f"({', '.join(repr(v) for v in x)})" for x in xs)
    plain = [(label, license_scan.plain_words(text), keys) for label, text, keys in license_scan.NOTICES]
    notices = ", ".join(f"('{label}', {words!r})" for label, words, _ in plain)
    anchors = rows((label, license_scan.place_of(words, keys[0]), keys[0], len(keys[0].split())) for label, words, keys in plain)
    others = rows((label, license_scan.place_of(words, k), k, len(k.split())) for label, words, keys in plain for k in keys[1:])
    phrases = rows((p, label, len(p.split())) for p, label in license_scan.PHRASES)
    return rf"""
WITH notices(label, t) AS (VALUES {notices}), anchors(label, place, phrase, k) AS (VALUES {anchors}), others(label, place, phrase, k) AS (VALUES {others}), phrases(phrase, label, k) AS (VALUES {phrases}),
docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
base AS (SELECT rid, p.label, i AS start FROM docs, phrases p, unnest(range(len(w))) r(i) WHERE array_to_string(w[i + 1 : i + k], ' ') = phrase),
places AS (SELECT rid, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY rid),
words AS (SELECT rid, i, w[i + 1] AS word FROM docs, unnest(range(len(w))) r(i)),
candidates AS (SELECT DISTINCT x.rid, a.label, x.i - a.place AS start FROM words x JOIN anchors a ON x.word = split_part(a.phrase, ' ', 1) JOIN docs USING (rid) WHERE array_to_string(w[x.i + 1 : x.i + a.k], ' ') = a.phrase),
missing AS (SELECT c.rid, c.label, c.start FROM candidates c JOIN docs USING (rid) JOIN others o ON o.label = c.label
 WHERE NOT list_bool_or(list_transform(range(c.start + o.place - {license_scan.SLACK}, c.start + o.place + {license_scan.SLACK} + 1), lambda p: p >= 0 AND array_to_string(w[p + 1 : p + o.k], ' ') = o.phrase))),
verified AS (SELECT * FROM candidates ANTI JOIN missing USING (rid, label, start)),
shares AS (SELECT v.rid, v.label, list_sum(list_transform(range(len(t)), lambda i: CASE WHEN v.start + i >= 0 AND w[v.start + i + 1] = t[i + 1] THEN 1 ELSE 0 END))::DOUBLE / len(t) AS share
 FROM verified v JOIN docs USING (rid) JOIN notices USING (label)),
found AS (SELECT rid, list(DISTINCT label) AS more, max(share) AS share FROM shares GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
 array_to_string(list_sort(coalesce(labels, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(more, [])))), ',') AS labels,
 coalesce(share, CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END)::DOUBLE AS score
FROM docs LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)
"""


_OP7 = """
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
total AS (SELECT sum(n)::DOUBLE AS goal, count(*)::DOUBLE AS weight FROM counts),
rates AS (SELECT source, 1.0::DOUBLE * goal / weight / n AS rate FROM counts, total),
draws AS (SELECT source, greatest(1, ceil(rate / 8.0))::INT AS d, rate / greatest(1, ceil(rate / 8.0))::INT AS mean FROM rates),
terms AS (
  WITH RECURSIVE t AS (
    SELECT source, d, mean, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM draws
    UNION ALL SELECT source, d, mean, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM t WHERE k < 48)
  SELECT source, d, list(cdf ORDER BY k) AS cdfs FROM t GROUP BY source, d),
counted AS (
  SELECT doc.*, (SELECT sum(len(list_filter(cdfs, lambda c: c <= ('0x' || substr(md5('mix|' || coalesce(doc.doc_id::VARCHAR, 'null') || '|' || i.i), 1, 13))::BIGINT / 4503599627370496.0)))
    FROM range(1, d + 1) i(i)) AS copies
  FROM documents doc JOIN terms ON doc.source IS NOT DISTINCT FROM terms.source)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy,
       md5('mix|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy) AS mix_key
FROM (SELECT *, unnest(range(1, copies::INT + 1)) AS copy FROM counted)
"""

_OP9 = r"""
WITH items AS (
  SELECT DISTINCT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM items, unnest(range(1, greatest(len(w) - 10, 0) + 2)) r(i) WHERE len(w) > 0),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
grams AS (
  SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM docs, (SELECT DISTINCT n FROM windows) l, unnest(range(1, len(w) - n + 2)) r(i)),
hits AS (SELECT rid, n, i, item FROM grams JOIN windows USING (n, win)),
hit_words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, n, i FROM hits)) GROUP BY rid),
hit_items AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hits GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

_HOST = r"translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP10 = rf"""
WITH parts AS (
  SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m|blog)\.', ''), ':[0-9]*$', '') || regexp_replace(regexp_replace(path, '/+$', ''), '\.html?$', '') END AS canon
  FROM parts),
judged AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule, CASE
    WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
    WHEN canon IN (SELECT canon FROM keyed WHERE regexp_matches(url, '[?&]ref=') AND canon IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""


_WHOLE = "list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v"
_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)"
_APART = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
#: floor of a mean; exact while counts stay under 2**26
_MEAN = "floor(sum(x)::DOUBLE / count(*))::BIGINT"


def _op11() -> str:
    """The SQL of the clustering: plain Lloyd rounds in which all vectors meet all centroids."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, {_WHOLE} FROM embeddings WHERE len(embedding) = 64 AND {_SOUND})",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), v) - 1 AS c, v FROM kept QUALIFY c < 40)",
    ]
    for r in range(6):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, min({_APART} * 40 + c.c) AS m FROM kept k, c{r} c GROUP BY rid)")
        if r < 5:
            means = f"SELECT m % 40 AS c, i, {_MEAN} AS x FROM (SELECT m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN kept USING (rid)) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS v FROM ({means}) GROUP BY c) n USING (c))")
    steps.append("final AS MATERIALIZED (SELECT rid, m % 40 AS c, m // 40 AS d FROM a5)")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.v, ',')) AS centroid_sha256
FROM final JOIN c5 USING (c) JOIN kept USING (rid)"""


def _op13() -> str:
    """The SQL of the vector codes: every part meets every entry of its codebook."""
    steps = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, {_WHOLE} FROM embeddings WHERE {_SOUND})",
        "k AS MATERIALIZED (SELECT rid, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, range(16) t(p))",
        "c0 AS MATERIALIZED (SELECT p, e, k.v FROM k JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id NULLS LAST, v) - 1 AS e FROM kept QUALIFY e < 64) USING (rid))",
    ]
    for r in range(3):
        steps.append(f"a{r} AS MATERIALIZED (SELECT rid, p, min({_APART} * 64 + c.e) AS m FROM k JOIN c{r} c USING (p) GROUP BY ALL)")
        if r < 2:
            means = f"SELECT p, m % 64 AS e, i, {_MEAN} AS x FROM (SELECT p, m, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r} JOIN k USING (rid, p)) GROUP BY ALL"
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM ({means}) GROUP BY p, e) n USING (p, e))")
    return f"""WITH {", ".join(steps)},
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c2),
coded AS (SELECT rid, string_agg(lower(printf('%02x', (m % 64)::INT)), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (rid), books"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroids": _op11(), "op13_vector_codes": _op13(), "op4_exact_dedup": _OP4, "op5_license_scan": _op5(), "op7_mixing": _OP7, "op9_decontamination": _OP9, "op10_url_filter": _OP10}
