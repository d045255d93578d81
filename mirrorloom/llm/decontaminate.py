"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, new_column, ship

WINDOW = 10
#: An automaton takes about this many bytes of windows, some 350 MB of a Python worker; more items are dealt over several automata.
MAX_AUTOMATON_BYTES = 8 << 20

# Every byte that is no word character becomes a space, A-Z become a-z; bytes over 0x7F stay.
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_AUTOMATA: dict[str, object] = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def windows_of(text: str | None, width: int = WINDOW) -> list[str]:
    """The windows of an item in normal form, one Latin-1 character per UTF-8 byte."""
    words = words_of(text)
    n = max(1, len(words) - width + 1) if words else 0
    return [f" {b' '.join(words[i : i + width]).decode('latin-1')} " for i in range(n)]


def _automaton(key: str, items, width: int):
    """The automaton of a broadcast list of (item, text); built once in each Python worker."""
    if key not in _AUTOMATA:
        import ahocorasick

        windows: dict[str, set[str]] = {}
        for item, text in items.value:
            for w in windows_of(text, width):
                windows.setdefault(w, set()).add(item)
        made = ahocorasick.Automaton()
        for w, ids in windows.items():
            made.add_word(w, (w.count(" ") - 1, tuple(sorted(ids))))
        if windows:
            made.make_automaton()
        _AUTOMATA.clear()
        _AUTOMATA[key] = made
    return _AUTOMATA[key]


def scan(text: str | None, automaton) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """Words, hit words, items, and the hit spans as character offsets of the original text."""
    words = words_of(text)
    if not words or not len(automaton):
        return len(words), 0, [], []
    line = f" {b' '.join(words).decode('latin-1')} "
    items: set[str] = set()
    spans: list[list[int]] = []  # of words: start, end
    at = counted = 0  # spaces in line[:at]
    for end, (n, ids) in automaton.iter(line):
        counted += line.count(" ", at, end)
        at = end
        items.update(ids)
        first, last = counted - n, counted
        # Ends rise, but a longer pattern may begin before spans that are there already.
        while spans and spans[-1][0] >= first:
            spans.pop()
        if spans and spans[-1][1] >= first:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last])
    hit = sum(b - a for a, b in spans)
    if not hit:
        return len(words), 0, [], []
    edges = [m.span() for m in _WORD.finditer(text)]
    return len(words), hit, sorted(items), [(edges[a][0], edges[b - 1][1]) for a, b in spans]


def _pass(docs: DataFrame, items: list[tuple[str, str]], text_col: str, to: str, width: int) -> DataFrame:
    """docs with the struct column ``to`` that one automaton finds."""
    ship(docs.sparkSession)
    sent, key = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    @F.pandas_udf("n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(key, sent, width)
        for texts in batches:
            rows = [scan(t, automaton) for t in texts]
            yield pd.DataFrame({"n_words": [r[0] for r in rows], "n_hit": [r[1] for r in rows], "items": [r[2] for r in rows], "spans": [[{"begin": a, "end": b} for a, b in r[3]] for r in rows]})

    return docs.withColumn(to, look(F.col(text_col).cast("string")))


def _unite(parts: list[dict], text: str | None) -> tuple[int, int, list[str], list[dict]]:
    """What several automata found in one text."""
    spans: list[list[int]] = []
    for a, b in sorted((s["begin"], s["end"]) for p in parts for s in p["spans"]):
        if spans and (a <= spans[-1][1] or not words_of(text[spans[-1][1] : a])):  # no word lies between them
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    hit = sum(len(words_of(text[a:b])) for a, b in spans)
    return parts[0]["n_words"], hit, sorted({i for p in parts for i in p["items"]}), [{"begin": a, "end": b} for a, b in spans]


def find_contamination(docs: DataFrame, benchmark: DataFrame, to: str = "found", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WINDOW, max_bytes: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """docs with the struct ``to``: n_words, n_hit, items (as sorted strings) and spans (offsets in the original text).

    A-Z count as a-z; words are runs of digits, letters and characters beyond ASCII. A
    window is ``width`` consecutive words of an item; an item of fewer words is one window,
    one without words, text or identifier none. A document word is hit inside any occurrence
    of a window. Null and empty texts have no words. Repeated rows each give a row, repeated
    items count once. An empty benchmark hits nothing, an empty table gives an empty result. ``to`` must be
    a new column (ValueError). One text's words are held at a time; its spans are the same for any number of automata.

    What is broadcast is bounded: one automaton takes windows of ``max_bytes`` at most. The
    items of a larger benchmark are dealt over several automata by hash; the texts are then
    scanned once for each, the findings written, and united by identifier of text and row.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("string").alias("t")).dropna().distinct()
    new_column(docs, to)
    total = items.agg(F.sum(F.octet_length("t") * width)).first()[0] or 0
    n = max(1, -(-int(total) // max_bytes))
    take = lambda part: [(r.i, r.t) for r in part.toLocalIterator()]
    if n == 1:
        return _pass(docs, take(items), text_col, to, width)
    sha, part_sha = fresh(docs, "text_sha", "part_sha")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = materialize(docs.select(F.sha2(text, 256).alias("sha"), text.alias("t")).dropDuplicates(["sha"]), "texts")
    found = None
    for k in range(n):
        shard = take(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k))
        part = materialize(_pass(texts, shard, "t", "f", width).select("sha", "f"), "part")
        found = part if found is None else found.unionByName(part)

    @F.pandas_udf("n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>")
    def unite(parts: pd.Series, text: pd.Series) -> pd.DataFrame:
        rows = [_unite(list(p), t) for p, t in zip(parts, text)]
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans"])

    united = found.groupBy("sha").agg(F.collect_list("f").alias("fs")).join(texts, "sha")
    united = materialize(united.select(F.col("sha").alias(part_sha), unite("fs", "t").alias(to)), "united")
    joined = docs.withColumn(sha, F.sha2(text, 256)).join(united, F.col(sha) == F.col(part_sha), "left")
    return joined.select(*[docs[c] for c in docs.columns], to)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no window of an item occurs, with all their columns."""
    (to,) = fresh(docs, "found")
    return find_contamination(docs, benchmark, to, **options).filter(F.col(f"{to}.n_hit") == 0).drop(to)
