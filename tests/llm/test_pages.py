"""HTML extraction and URL filters."""

import hashlib
import itertools
import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from mirrorloom.llm import html_extract, queries, url_filter

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="no-ads"><header>Site</header><nav><ul><li>a<li>b</ul></nav><!-- x -->'
    '<div class="ad">AD</div><aside>side</aside><div class="cookie-notice">cookies</div><article><h1>Ti &amp; tle</h1><p><b>One <i>two</i>\n three<br>four<p>Five &lt;six&gt; &#233;</p>'
    '<form><input value="x">Mail</form><section class="comments"><p>c1</p></section><p>Seven</article><footer>f</footer></body>'
)


def seen(page):
    return [(x, s) for x, s, _ in html_extract.lines_of(page)]


def test_lines():
    kept = [x for x, s in seen(PAGE) if s == html_extract.KEEP]
    assert kept == ["Ti & tle", "One two three four", "Five <six> é", "Seven"]
    assert seen(None) == [] and seen("") == [] and seen("a < b & c") == [("a < b & c", html_extract.OPEN)]
    assert seen("<p title='a>b'>x</p><p>y") == [("x", 1), ("y", 1)] and seen('<script data-x="a<b">no</script>yes') == [("yes", 1)]


def test_class_words_inside_an_article_drop_nothing():
    page = '<article class="layout-sidebar-left"><p id="ad-hoc-analysis">One<table class="banner"><tr><td>Two</table><div class="comment-list"><p>no</div><div class="no-ads">Three</div></article>'
    assert [x for x, s in seen(page) if s == html_extract.KEEP] == ["One", "Two", "Three"]
    assert seen('<div class="post share-enabled">text</div><div class="share-bar">no</div>') == [("text", 1), ("no", 0)]


def test_broken_and_deep_pages_take_linear_time():
    began = time.process_time()
    for piece in ("<div>", "<a ", '<a "', "<a '\">", "<!", "<script>", "</script   ", '<a ">"', "<p ", "<div>x", "</div>"):
        html_extract.lines_of(piece * 100_000)
    assert time.process_time() - began < 30


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines(a, b):
    mask = html_extract.common_lines(a, b)
    common = [x for x, m in zip(a, mask) if m]
    rest = iter(b)
    assert all(x in rest for x in common)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    assert len(common) == best[-1][-1]


def test_halving_finds_as_many(monkeypatch):
    rng = random.Random(5)
    for size in (3, 40, 400):
        a, b = [[rng.randrange(size // 2) for _ in range(size)] for _ in range(2)]
        whole = html_extract.common_lines(a, b)
        monkeypatch.setattr(html_extract, "ROW_BITS", 8)
        halved = html_extract.common_lines(a, b)
        monkeypatch.undo()
        rest = iter(b)
        assert sum(whole) == sum(halved) and all(x in rest for x, m in zip(a, halved) if m)


def brute(rows, df):
    """page_id, text and the number of shared lines of (page_id, url, html), with plain lists in place of joins and ranges."""
    digests = {bytes(r.rid): r.digest for r in html_extract.line_hashes(df, "page_id", "url", "html").collect()}  # the order of pages at one path
    found, hosts = {}, {}
    for row in dict.fromkeys(rows):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", row[1] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        lines = html_extract.lines_of(row[2])
        keys, guards = [html_extract.key_of(*x) for x in lines], [html_extract.guard_of(*x[:2]) for x in lines]
        guarded = tuple(k for k, g in zip(keys, guards) if g)
        rid = hashlib.md5("\u0001".join("\u0000" if v is None else str(v) for v in row).encode()).digest()
        found[row] = (host, keys, guards, guarded, lines)
        hosts.setdefault(host, []).append(((path.encode(), digests[rid], rid), row))
    out = []
    for row in rows:
        host, keys, guards, guarded, lines = found[row]
        order = [r for _, r in sorted(hosts[host])]
        texts = {found[r][3] for r in order}
        here = order.index(row)
        goes = [False] * len(keys)
        for side in (order[:here][::-1], order[here + 1 :]):
            near = next((r for r in side if found[r][3] != guarded), None)
            for n, m in enumerate(html_extract.common_lines(keys, found[near][1]) if near else []):
                stands = sum(keys[n] in g for g in texts)
                prose = stands >= html_extract.SITE_PAGES and stands >= html_extract.SITE_SHARE * len(texts)
                goes[n] |= m and [True, True, prose, prose and len(texts) >= html_extract.ARTICLE_HOST][guards[n]]
        out.append((row[0], "\n\n".join(x for (x, s, _), g in zip(lines, goes) if s != html_extract.DROP and not g), sum(goes)))
    return sorted(map(str, out))


def test_query_against_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html")
    assert sorted(str((r.page_id, r.text, r.n_shared)) for r in queries.op1_html_extract(spark, small).collect()) == brute([tuple(r) for r in df.collect()], df)


def test_comparison_decides(spark):
    """Where there is no article the menu goes as neighbours have it; alone, a page keeps it. Around an article the comparison deletes the frame; alone, the markup does."""
    page = lambda k: f"<body><div>Menu</div><div>Story {k}</div></body>" if k < 20 else f"<nav>{k}</nav><article><p>Story {k}</p></article><p>Tell your friends</p>"
    rows = [(k, f"http://{'open' if k < 20 else 'article'}.example/p/{k}", page(k)) for k in range(10, 30)]
    rows += [(100 + k, f"http://{k}.example/p", page(k)) for k in (10, 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert sorted(str((i, r.text, r.n_shared)) for i, r in got.items()) == brute(rows, df)
    assert all(got[k].text == f"Story {k}" and got[k].n_shared == (1 if k < 20 else 2) and got[k].n_marked == 0 for k in range(10, 30))
    assert got[110].text == "Menu\n\nStory 10" and got[120].text == "Story 20" and got[120].n_marked == 2


def test_lines_of_the_site_inside_articles_go_and_passages_stay(spark):
    """A letter box and "Share" inside each article go on a host of 30 pages, not on one of 15; what two articles share stays."""
    letter, passage = "Subscribe to our letter and read all that is new on these pages each week.", "A passage that two articles of the host quote in full, as it was said at the time."
    body = lambda k: f"<nav>{k}</nav><article><h1>Story {k}</h1><p>Told on page {k}.</p><p>{letter}</p>{f'<p>{passage}</p>' if k in (4, 5) else ''}<p>Share</p></article>"
    rows = [(k, f"https://large.example/a/{k:02}", body(k)) for k in range(30)] + [(100 + k, f"https://small.example/a/{k:02}", body(k)) for k in range(15)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(df).collect()}
    assert sorted(str((i, r.text, r.n_shared)) for i, r in got.items()) == brute(rows, df)
    own = lambda k: [f"Story {k}", f"Told on page {k}."]
    assert all(got[k].text == "\n\n".join([*own(k), *([passage] if k in (4, 5) else [])]) for k in range(30))
    assert all(got[100 + k].text == "\n\n".join([*own(k), letter, *([passage] if k in (4, 5) else []), "Share"]) for k in range(15))


def pages(spark):
    body = lambda k: f"<html><body><div>Menu of the site</div><div>Story {k} is told here</div><div>All rights reserved</div></body></html>"
    rows = [(i, f"https://h.example/a/{i}", body(i)) for i in range(40)] + [(100, None, None), (101, None, PAGE), (102, "https://alone.example/x", body(9)), (103, "https://h.example/a/7", body(7)), (None, "nonsense", "<p>text</p>"), (104, "https://h.example/a/7", body(7)), (104, "https://h.example/a/7", body(7))]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, rid long, host string")


def test_shared_lines_go(spark):
    out = {(r.page_id): r for r in html_extract.extract(pages(spark).repartition(7)).collect()}
    assert out[3].text == "Story 3 is told here" and out[3].n_chars == len(out[3].text) and out[3].n_shared == 2
    assert out[102].text.startswith("Menu of the site\n\nStory 9") and out[100].text == "" and out[None].text == "text"
    assert html_extract.extract(pages(spark)).count() == 47 and html_extract.extract(pages(spark).limit(0)).count() == 0


def test_copies_and_shared_passages_keep_their_text(spark):
    out = {r.page_id: r for r in html_extract.extract(pages(spark).repartition(7)).collect()}
    assert out[7].text == out[103].text == out[104].text == "Story 7 is told here" and out[7].n_shared == 2
    passage, notice = "A passage that two pages of the host quote in full, as it was said at the time.", "This notice of the house stands on each and every page of the host, whatever it tells."
    body = lambda k, more="": f"<body><div>Menu</div><div>{notice}</div><div>Story {k}</div>{more}</body>"
    rows = [(i, f"https://n.example/a/{'x' if i in (4, 5) else ''}{i}", body(i, f"<div>{passage}</div>" if i in (4, 5) else "")) for i in range(8)]
    rows += [(20 + i, f"http{'s' * (i % 2)}://c.example/p{'?ref=x' if i > 1 else ''}", body(3)) for i in range(4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for n in ("1", "5"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.page_id: r for r in html_extract.extract(df).collect()}
            assert all(got[i].text == f"Story {i}" + (f"\n\n{passage}" if i in (4, 5) else "") for i in range(8)) and got[4].n_shared == 2
            assert all("Story 3" in got[20 + i].text and got[20 + i].n_shared == 0 for i in range(4))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_neighbours_do_not_depend_on_the_ranges(spark):
    hashes = html_extract.line_hashes(pages(spark), "page_id", "url", "html")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        got = []
        for n in ("1", "3", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            got.append(sorted(map(tuple, html_extract.nearest(hashes).collect())))
        assert got[0] == got[1] == got[2] and len(got[0]) > 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query_keeps_the_article(spark, small):
    for r in queries.op1_html_extract(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").drop("url"), "page_id").collect():
        assert r.text and "<p>" not in r.text and "&copy;" not in r.text and "©" not in r.text and r.n_chars == len(r.text)


def urls(spark):
    listed = ["a.org/x", "b.net/de/1", "c.com/en/9", None]
    pages = ["https://www.a.org/x.html?q=1", "http://A.org:8080/x/", "https://m.b.net/de/1", "http://x.example.com/en/7", "http://x.example.com/en/8", "http://y.example.net/de/80", "ftp://z/", "plain", None, "http://com/en/", "http://xcom/en/1", "https://blog.c.com/fr/9#t", "http://o.org/es/", "://h/p"]
    return spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(pages)], "page_id long, url string, host string, key int"), spark.createDataFrame([(k,) for k in listed + listed], "key string")


def test_verdicts(spark):
    pages, listed = urls(spark)
    want = {0: "block", 1: "block", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow", 12: "block", 13: "allow"}
    for most in (1 << 20, 0):  # the filter by broadcast, and by a join
        out = url_filter.filter_urls(pages, queries.URL_RULES, listed, max_broadcast=most)
        got = {r.page_id: r for r in out.collect()}
        assert {k: r.verdict for k, r in got.items()} == want and got[3].rule == "example.com/en/7" and got[5].rule == "example.net/de/8"
        assert (got[8].host, got[8].path) == ("", "") and got[13].host == "h" and got[0].source_host == "h"
        many = pages.unionByName(spark.range(2000).selectExpr("id + 100 as page_id", "cast(null as string) as url", "'h' as host", "1 as key"))
        assert url_filter.filter_urls(many, queries.URL_RULES, listed, max_broadcast=most).filter("page_id >= 100 and verdict = 'allow' and host = ''").count() == 2000
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES, listed).count() == 0
    assert url_filter.filter_urls(pages, [], listed.limit(0)).filter("verdict = 'block'").count() == 0


def test_a_line_break_at_the_end_belongs_to_the_address(spark, tmp_path):
    import duckdb

    ends = ["", "\n", "\r", "\r\n", "\u2028", "\x85"]
    urls = [f"http://www.a.org{host}{path}{end}" for host in ("", ":80") for path in ("", "/x/", "/x.html") for end in ends] + [f"http://a.org{path}{end}?ref=1" for path in ("", "/x") for end in ends] + ["http://b.com/en/1\n", "http://example.com/en/7\n"]
    spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in queries.op10_url_filter(spark, str(tmp_path)).select("page_id", "host", "path", "verdict").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(con.sql(f"SELECT page_id, host, path, verdict FROM ({queries.oracle_sql()['op10_url_filter']})").fetchall())
    assert {v for i, _, _, v in got[:36]} == {"allow", "block"}


def test_bloom_has_no_false_negatives(spark):
    rng = random.Random(1)
    keys = [f"host{rng.random()}/p{i}" for i in range(3000)]
    listed = spark.createDataFrame([(k,) for k in keys], "key string")
    pages = spark.createDataFrame([(i, f"http://{k}") for i, k in enumerate(keys + [k + "z" for k in keys])], "page_id long, url string")
    out = url_filter.filter_urls(pages, [], listed)
    assert out.filter("listed").count() == 3000 and out.filter("listed and page_id >= 3000").count() == 0
