"""HTML extraction by differencing each page with the page of the nearest URL on its host."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship
from .url_filter import url_host, url_path

# Elements by what they mean for the text.
RAW = "script style noscript template svg iframe object canvas textarea".split()
NOT_CONTENT = "head nav header footer aside form menu dialog button select fieldset".split()
CONTENT = "article main".split()
BLOCKS = (
    "html head title body p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption section article main "
    "header footer nav aside form menu dialog blockquote pre figure figcaption address details summary fieldset center"
).split()
VOID = "hr area base br col embed img input link meta param source track wbr".split()
# Words of class, id and role that mark what isn't the article, and those that may stand beside them in a compound.
MARKS = (
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar rail widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentlist "
    "discussion respond disqus replies share sharing social related recommended recommendations toolbar login search pagination pager complementary contentinfo"
).split()
BESIDE = "area bar block bottom box button buttons container form icons inner item items left links list outer page panel posts right section site slot top unit wrapper".split()
# Elements of prose, which aren't judged by their class.
PROSE_ELEMENTS = "html body article main p h1 h2 h3 h4 h5 h6 pre blockquote figure table tr td th li dl dt dd".split()

#: Possessive, so that no part is read twice: a broken tag ends where the next one begins.
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^<>]*+>?|<(" + "|".join(RAW) + r")\b(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+>.*?(?:</\1\b[^<>]*+>?|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>?",
    re.S | re.I,
)
_MARKED = re.compile(r"""(?:^|\s)(?:class|id|role|data-role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_NOT, _CONTENT, _BLOCKS, _VOID, _MARKS, _BESIDE, _PROSE = map(frozenset, (NOT_CONTENT, CONTENT, BLOCKS, VOID, MARKS, BESIDE, PROSE_ELEMENTS))

DROP, OPEN, KEEP = 0, 1, 2  # what the markup says of a line
FRAME, SHORT, LONG, ARTICLE = 0, 1, 2, 3  # what a neighbour that has the line too means

#: An OPEN line of so many characters is taken for prose: that a neighbour has it too doesn't delete it.
PROSE = 60
#: It is the site's where it stands on so many different pages of its host, and on so large a share of them.
SITE_PAGES, SITE_SHARE = 3, 0.5
#: A line inside an article is judged so only on a host of so many different pages; smaller ones say too little against the markup.
ARTICLE_HOST = 20
#: Parts of a host where its pages meet its lines.
SALTS = 16
#: The rows of bits of a common subsequence are held up to this many; longer pages are halved first.
ROW_BITS = 1 << 26


def lines_of(page: str | None) -> list[tuple[str, int, int]]:
    """The text lines (blocks) of a page in order, each with what its markup says and its place in the markup.

    KEEP: inside an article or main element. DROP: inside an element, or one marked by class,
    id or role, that isn't part of an article, or outside the article on a page that has one.
    OPEN: anything else. The place is a hash of the names and classes of the blocks around the line. Tags may be
    unclosed; character references are decoded in text only. Takes time in proportion to the page.
    """
    import xxhash

    page = page or ""
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []  # element, state and place around it
    opened: Counter = Counter()
    state, place, parts, at = OPEN, 0, [], 0

    def close_line() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if line:
            out.append((line, state, place))

    for m in _TAG.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name, closing, attributes = name.lower(), m[2] == "/", m[4]
        if name in _VOID:
            parts.append(" ")
            if name == "hr":
                close_line()
            continue
        block = name in _BLOCKS or name in _NOT
        marked = not closing and state != DROP and _is_marked(name, attributes)
        if not (block or marked or opened[name]):
            continue  # an inline element
        close_line()
        if closing:
            while opened[name]:  # whatever stands open inside ends with it
                ended, state, place = stack.pop()
                opened[ended] -= 1
                if ended == name:
                    break
            continue
        if block and stack and (stack[-1][0] == "p" or stack[-1][0] == name and name in ("li", "td", "th", "tr", "dt", "dd")):
            ended, state, place = stack.pop()  # it ends where the next one begins
            opened[ended] -= 1
            marked = state != DROP and _is_marked(name, attributes)
        stack.append((name, state, place))
        opened[name] += 1
        found = _MARKED.findall(attributes)
        place = xxhash.xxh64_intdigest(" ".join([name, *found]), place)
        if state != DROP:
            state = DROP if marked or name in _NOT else KEEP if name in _CONTENT else state
    parts.append(page[at:])
    close_line()
    if any(s == KEEP for _, s, _ in out):
        out = [(line, DROP if s == OPEN else s, p) for line, s, p in out]
    return out


def _is_marked(name: str, attributes: str) -> bool:
    """Whether class, id or role say that an element isn't the article, or it is hidden."""
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    if name in _PROSE:
        return False
    for value in _MARKED.findall(attributes):
        for word in value.strip("\"'").lower().split():
            found = _PART.findall(word)  # a compound counts if it says nothing else
            if any(p in _MARKS for p in found) and all(p in _MARKS or p in _BESIDE for p in found):
                return True
    return False


def key_of(line: str, state: int, place: int) -> int:
    """What a line is compared by: what the markup drops by its place, as the words of menus and adverts change from page to page; all else by its text."""
    import xxhash

    return (place if state == DROP else xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"))) - (1 << 63)


def guard_of(line: str, state: int) -> int:
    """FRAME, SHORT: a line that goes where a neighbour has it. LONG (prose): it goes only as a line of the whole site. ARTICLE: so too, and only on a large host."""
    return ARTICLE if state == KEEP else FRAME if state == DROP else LONG if len(line) >= PROSE else SHORT


def _rows(x: list[int], y: list[int]) -> Iterator[int]:
    """For each beginning of x, bit j: the line j of y doesn't lengthen the common subsequence with y's lines before it."""
    where: dict[int, int] = {}
    for j, v in enumerate(y):
        where[v] = where.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1
    row = full
    for v in x:
        u = row & where.get(v, 0)
        row = (row + u | row - u) & full
        yield row


def _lengths(x: list[int], y: list[int]) -> np.ndarray:
    """The lengths of the longest common subsequences of x with each beginning of y."""
    row = (1 << len(y)) - 1
    for row in _rows(x, y):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[bool]:
    """Which lines of a belong to a longest common subsequence with b.

    Equal ends are cut off first. The rest is compared by rows of bits; beyond ROW_BITS of them it is halved
    where the two halves share most, so the memory is in proportion to the lines.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    both = set(x) & set(y)  # no other line can be shared
    at, x, y = [i for i, v in enumerate(x) if v in both], [v for v in x if v in both], [v for v in y if v in both]
    shared = [k < head or k >= len(a) - tail for k in range(len(a))]
    for i, m in zip(at, _common(x, y)):
        shared[head + i] = m
    return shared


def _common(x: list[int], y: list[int]) -> list[bool]:
    if not x or not y:
        return [False] * len(x)
    if len(x) > 1 and len(x) * len(y) > ROW_BITS:
        k = len(x) // 2
        cut = int(np.argmax(_lengths(x[:k], y) + _lengths(x[k:][::-1], y[::-1])[::-1]))
        return common_lines(x[:k], y[:cut]) + common_lines(x[k:], y[cut:])
    shared, rows = [False] * len(x), list(_rows(x, y))
    i, j = len(x), len(y)
    while i and j:  # a set bit: the last line of y adds nothing in this row
        if rows[i - 1] >> j - 1 & 1:
            j -= 1
        elif i > 1 and not rows[i - 2] >> j - 1 & 1:
            i -= 1
        else:
            shared[i - 1] = True
            i, j = i - 1, j - 1
    return shared


def page_key(id_col: str, url_col: str, html_col: str) -> Column:
    """128 bits of a hash of a page's identifier, URL and text: rows that repeat a page share it, and it is the same in every pass."""
    return F.unhex(F.md5(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (id_col, url_col, html_col)])))


def line_hashes(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """rid, host, path, the keys of the page's lines, their guards, and a digest of the lines; one row for each distinct page."""

    @F.pandas_udf("keys array<long>, guards array<tinyint>")
    def hashes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            lines = [lines_of(t) for t in texts]
            yield pd.DataFrame({"keys": [[key_of(*x) for x in found] for found in lines], "guards": [[guard_of(x[0], x[1]) for x in found] for found in lines]})

    url = F.col(url_col).cast("string")
    slim = pages.select(page_key(id_col, url_col, html_col).alias("rid"), url_host(url).alias("host"), url_path(url).alias("path"), hashes(F.col(html_col).cast("string")).alias("lines"))
    digest = F.xxhash64(keys_of("lines", f">= {SHORT}"))  # without the frame, which may change from copy to copy
    return materialize(slim.dropDuplicates(["rid"]).select("rid", F.xxhash64("host").alias("h"), "host", "path", F.col("lines.keys").alias("keys"), F.col("lines.guards").alias("guards"), digest.alias("digest")), "hashes")


def keys_of(struct: str, guard: str) -> Column:
    """The keys of the lines whose guard fits."""
    dot = f"{struct}." if struct else ""
    return F.expr(f"transform(filter(arrays_zip({dot}keys, {dot}guards), x -> x.guards {guard}), x -> x.keys)")


def site_lines(hashes: DataFrame) -> DataFrame:
    """h (a hash of the host), site, large: the lines outside the frame on most of a host's pages, and whether it has ARTICLE_HOST pages; pages of equal text count once. Hosts without such lines have no row."""
    lines = hashes.select("h", "digest", F.array_distinct(keys_of("", f">= {SHORT}")).alias("lines"))
    sizes = hashes.select("h", "digest").distinct().groupBy("h").agg(F.count("*").alias("pages"))
    stands = lines.select("h", "digest", F.explode("lines").alias("line")).distinct().groupBy("h", "line").agg(F.count("*").alias("n"))
    often = stands.filter(F.col("n") >= SITE_PAGES).join(sizes, "h").filter(F.col("n") >= SITE_SHARE * F.col("pages"))
    return often.groupBy("h").agg(F.collect_list("line").alias("site"), (F.max("pages") >= ARTICLE_HOST).alias("large"))  # on most pages, so not many more than a page has


def nearest(hashes: DataFrame) -> DataFrame:
    """(rid, other): the neighbours of each page, one before and one after it in the order of host and path.

    Neighbours differ: pages of equal text that follow each other are a run, and its pages have the pages next to the run
    as neighbours. The slim rows are sorted over ranges, so a host of any size is spread; a few rows,
    the ends of the ranges, are joined up afterwards. Hosts that have only pages of equal text have no row.
    """

    kinds = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("rid", pa.binary()), ("host", pa.string()), ("path", pa.string()), ("digest", pa.int64()), ("other", pa.binary())])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, run, ends = TaskContext.get().partitionId(), None, [], {}  # before: the row ahead of the run
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

        def met(rows: list[tuple], after: tuple | None) -> Iterator[tuple]:
            for rid, host, _, _ in rows:
                for kind, near in (("before", before), ("after", after)):
                    if near is None:
                        yield (kind, number, rid, None, None, None, None)  # it lies in another range
                    elif near[1] == host:
                        yield ("pair", number, rid, None, None, None, near[0])

        for batch in batches:
            rows = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("rid", "host", "path", "digest"))):
                if run and (run[-1][1], run[-1][3]) != (row[1], row[3]):
                    rows += met(run, row)
                    ends.setdefault("second", row)
                    before, run = run[-1], []
                ends.setdefault("first", row)
                run.append(row)
            if rows:
                yield table(rows)
        if run:
            rows = list(met(run, None))
            ends["last"] = run[-1]
            if before:
                ends["last but one"] = before
            yield table(rows + [(kind, number, *row, None) for kind, row in ends.items()])

    slim = hashes.select("rid", "host", "path", "digest").repartitionByRange("host", "path", "digest", "rid").sortWithinPartitions("host", "path", "digest", "rid")
    rows = materialize(slim.mapInArrow(pair, "kind string, part int, rid binary, host string, path string, digest long, other binary"), "pairs")
    ends: dict[int, dict[str, tuple]] = {}
    for r in rows.filter(~F.col("kind").isin("pair", "before", "after")).collect():  # four rows a range at most
        ends.setdefault(r.part, {})[r.kind] = (r.rid, r.host, r.path, r.digest)
    parts = sorted(ends)
    beyond = []
    for k, part in enumerate(parts):
        for kind, own, ahead, near, next_run in (("before", "first", parts[:k][::-1], "last", "last but one"), ("after", "last", parts[k + 1 :], "first", "second")):
            found = _different(ends[part][own], ((ends[q][near], ends[q].get(next_run)) for q in ahead))
            if found:
                beyond.append((part, kind, found[0]))
    far = hashes.sparkSession.createDataFrame(beyond, "part int, kind string, other binary")
    open_rows = rows.filter(F.col("kind").isin("before", "after")).select("part", "kind", "rid").join(F.broadcast(far), ["part", "kind"])
    return rows.filter("kind = 'pair'").select("rid", "other").unionByName(open_rows.select("rid", "other"))


def _different(own: tuple, ranges: Iterator[tuple[tuple, tuple | None]]) -> tuple | None:
    """The first row of own's host in other ranges that isn't of its run; of each range its nearest row and the one beyond that row's run."""
    for near, then in ranges:
        for row in (near, then):
            if row and row[1] != own[1]:
                return None
            if row and row[3] != own[3]:
                return row
    return None


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_lines, n_shared and n_marked.

    Each page is compared with its two neighbours by URL path on its host. Lines that it shares with one, in the order of
    a longest common subsequence, are deleted (n_shared). What stands in menus, footers, adverts and all else around an
    article is compared by its place in the markup, as its words change from page to page; all other lines by their text.
    Pages of equal text are no neighbours, so copies keep theirs. Prose that a neighbour has too goes only where it
    stands on most of the host's pages. So does a line of any length inside an article or main element, such as an invitation to a
    letter or "Share", but only on a host of ARTICLE_HOST different pages, as articles share passages.
    Then the markup has a second opinion on the lines that the comparison left (n_marked): one in a menu, header, footer, form,
    advert or comment goes even where no neighbour has it, as on a host of one page. Blocks are joined by two line ends.

    A null or empty page gives the empty text; a null URL has an empty host like other URLs without one. Rows that repeat a
    page each give a row and are one page to their neighbours. An empty table gives an empty result. Only the three named columns are
    read, so others may have any names. Each page is parsed twice, as keeping its lines would double what is written.
    """
    ship(pages.sparkSession)
    hashes = line_hashes(pages, id_col, url_col, html_col)
    # A host may hold most of the pages, so its few lines are met in several parts; pages of other hosts have no row here.
    sites = site_lines(hashes).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    slim = hashes.select("rid", "h", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int").alias("salt"))
    own = hashes.select("rid", "keys", "guards").join(slim.join(sites, ["h", "salt"]).select("rid", "site", "large"), "rid", "left")
    others = hashes.select(F.col("rid").alias("other"), F.col("keys").alias("other_keys"))

    @F.pandas_udf("array<boolean>")
    def differ(a: pd.Series, b: pd.Series, guards: pd.Series, site: pd.Series, large: pd.Series) -> pd.Series:
        def one(x, y, guard, often, most):
            site_wide = set(often) if often is not None else ()
            return [m and (g < LONG or g <= most and k in site_wide) for m, k, g in zip(common_lines(x, list(y)), x, guard)]

        return pd.Series([one(list(x), y, g, s, ARTICLE if h else LONG) for x, y, g, s, h in zip(a, b, guards, site, large)])

    masks = nearest(hashes).join(others, "other").join(own, "rid").select("rid", differ("keys", "other_keys", "guards", "site", F.coalesce("large", F.lit(False))).alias("d"))
    either = F.aggregate(F.slice("ds", 2, 1), F.element_at("ds", 1), lambda x, y: F.zip_with(x, y, lambda p, q: p | q))
    masks = materialize(masks.groupBy("rid").agg(F.collect_list("d").alias("ds")).select("rid", either.alias("shared")), "masks")  # two neighbours at most

    @F.pandas_udf("text string, places array<int>, n_lines long")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [[(i, x[0], x[1]) for i, x in enumerate(lines_of(t))] for t in texts]
            some = [[x for x in f if x[2] != DROP] for f in found]  # what the markup drops goes no further
            yield pd.DataFrame({"text": ["\n\n".join(x[1] for x in f) for f in some], "places": [[x[0] for x in f] for f in some], "n_lines": [len(f) for f in found]})

    parsed = pages.select(page_key(id_col, url_col, html_col).alias("rid"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), parse(F.col(html_col).cast("string")).alias("p"))
    # The masks have a row for each page, so they are never broadcast, at any size.
    joined = parsed.join(masks.hint("merge"), "rid", "left").select("page_id", "url", "p.*", F.coalesce("shared", F.array().cast("array<boolean>")).alias("shared"))
    goes = lambda i: F.coalesce(F.get("shared", F.get("places", i)), F.lit(False))
    stays = F.filter(F.split("text", "\n\n"), lambda line, i: ~goes(i))  # a line holds no line end
    some_go = F.exists("places", lambda p: F.coalesce(F.get("shared", p), F.lit(False)))
    n_shared = F.size(F.filter("shared", lambda x: x)).cast("long")
    n_kept = F.size(F.filter("places", lambda p: ~F.coalesce(F.get("shared", p), F.lit(False))))
    out = joined.select("page_id", "url", F.when(some_go, F.array_join(stays, "\n\n")).otherwise(F.col("text")).alias("text"), "n_lines", n_shared.alias("n_shared"), n_kept.alias("n_kept"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_shared", (F.col("n_lines") - F.col("n_shared") - F.col("n_kept")).alias("n_marked"))
