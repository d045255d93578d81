"""Licence scans by a positional index of rare words, in DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize
from .license_texts import COMMON, NOTICES

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: So many of the rarest words of a notice's anchor stand in the index; a notice that is there has them all.
RAREST = 3
#: A key phrase behind the anchor may stand so many words before or after its place (names and years are filled in).
SLACK = 16

Notice = tuple[str, str, list[str]]


def plain_words(text: str) -> list[str]:
    """The words of a notice, as ``words_of`` gives those of a document."""
    return [w for w in re.split(NOT_WORD, text.lower()) if w]


def place_of(words: list[str], phrase: str) -> int:
    """Where the phrase begins in the words."""
    parts = phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)


def words_of(text: Column) -> Column:
    """Words of the lower-cased text: runs of digits, letters and characters beyond ASCII."""
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def phrase_places(words: Column, lowered: Column, phrase: str) -> Column:
    """Starts of the phrase in the words, from 0; only texts with its longest word are looked through."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    at = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    places = F.filter(F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>")), at)
    longest = max(parts, key=len)
    return F.when(lowered.contains(longest), places).otherwise(F.array().cast("array<int>"))


def anchor_words(notices: list[Notice]) -> list[str]:
    """The words that may be looked up: those of the anchors that aren't common."""
    return sorted({w for _, _, keys in notices for w in keys[0].split()} - set(COMMON))


def postings(spark: SparkSession, notices: list[Notice], files: dict[str, int]) -> DataFrame:
    """word, label, place, needed: the index of each notice's RAREST rarest anchor words. As large as the notices, whatever the data.

    files: in how many files each word stands. needed: how many postings a notice has.
    """
    rows = []
    for label, text, keys in notices:
        words = plain_words(text)
        start, size = place_of(words, keys[0]), len(keys[0].split())
        own = [(w, i) for i, w in enumerate(words[start : start + size], start) if w not in COMMON]
        rarest = sorted({w for w, _ in own}, key=lambda w: (files.get(w, 0), w))[:RAREST]
        rows += [(w, label, i, sum(x in rarest for x, _ in own)) for w, i in own if w in rarest]
    return spark.createDataFrame(rows, "word string, label string, place int, needed int")


def _phrase_at(words: Column, at: Column, parts: list[str]) -> Column:
    return (at >= 0) & (F.slice(words, F.greatest(at, F.lit(0)) + 1, len(parts)) == F.array(*map(F.lit, parts)))


def _phrase_near(words: Column, at: int, parts: list[str]) -> Column:
    return F.exists(F.sequence(F.lit(at - SLACK), F.lit(at + SLACK)), lambda i: _phrase_at(words, i, parts))


def _share(label: Column, cut: Column, notices: list[Notice]) -> Column:
    """Of the notice that begins SLACK words into ``cut``: the share of its words that agree; null where a key phrase is missing."""
    out = F.lit(None).cast("double")
    for name, text, keys in notices:
        words = plain_words(text)
        ok = _phrase_at(cut, F.lit(SLACK + place_of(words, keys[0])), keys[0].split())
        for key in keys[1:]:
            ok = ok & _phrase_near(cut, SLACK + place_of(words, key), key.split())
        agree = F.zip_with(F.slice(cut, SLACK + 1, len(words)), F.array(*map(F.lit, words)), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
        out = F.when(label == name, F.when(ok, F.aggregate(agree, F.lit(0), lambda a, x: a + x) / F.lit(float(len(words))))).otherwise(out)
    return out


def _cut(words: Column, start: Column, size: Column) -> Column:
    """The words from SLACK before start to SLACK after its ``size`` words; nulls stand for those before the text."""
    first = start - SLACK
    before = F.array_repeat(F.lit(None).cast("string"), F.greatest(-first, F.lit(0)))
    return F.concat(before, F.slice(words, F.greatest(first, F.lit(0)) + 1, F.greatest(size + 2 * SLACK + F.least(first, F.lit(0)), F.lit(0))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: list[Notice] = NOTICES, phrases: list[tuple[str, str]] = PHRASES) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Base: the places where a phrase's words stand one after another. The method: of each notice
    the rarest words of its anchor phrase (by the files that hold them) are met with the documents'
    words; where all of them agree on the place where the notice begins, its words there are
    cut out, and the anchor, at its place, and the other key phrases, within SLACK words of theirs, are
    verified. A notice whose key phrases are there is always found, as the anchor holds the words
    looked up: no bound on the notices of a document, and none on its length. score: the largest share of
    a found notice's words that agree; 0.5 where only base phrases are found; else 0.

    Null and empty texts have no words. Repeated rows each give a row, null identifiers too. An empty
    table gives an empty result. Only the two named columns are read, so others may have any names. A very long
    text is one row of words; each place found adds one cut, as long as the notice.
    """
    spark = docs.sparkSession
    sizes = F.create_map(*[x for label, text, _ in notices for x in (F.lit(label), F.lit(len(plain_words(text))))])
    split = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), ascii_lower(F.col(text_col)).alias("lowered"), words_of(F.col(text_col)).alias("words"))
    places = [phrase_places(F.col("words"), F.col("lowered"), p) for p, _ in phrases]
    anchor = anchor_words(notices)
    rare = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(anchor))
    split = split.select("rid", "doc_id", "words", F.size("words").cast("long").alias("n_words"), *[p.alias(f"p{k}") for k, p in enumerate(places)], rare.alias("rare"))
    split = split.withColumn("held", F.array_distinct(F.col("rare.word")))
    complete = F.lit(False)  # a file that lacks a word of every anchor holds no notice
    for own in {frozenset(anchor_words([n])) for n in notices}:
        complete = complete | F.forall(F.array(*map(F.lit, sorted(own))), lambda w: F.array_contains("held", w))
    split = split.withColumn("complete", F.when(F.size("held") > 0, complete).otherwise(False))
    found_only = [F.when(F.col("complete"), F.col(c)).alias(c) for c in ("rare", "words")]
    scanned = materialize(split.select("rid", "doc_id", "n_words", *[f"p{k}" for k in range(len(phrases))], "held", *found_only), "scanned")

    files = scanned.select(F.explode("held").alias("word")).groupBy("word").count()
    index = postings(spark, notices, {r.word: r["count"] for r in files.collect()})  # a row for each anchor word
    found = scanned.select("rid", F.explode("rare").alias("r")).select("rid", F.col("r.word").alias("word"), F.col("r.at").alias("at"))
    placed = found.join(F.broadcast(index), "word").groupBy("rid", "label", (F.col("at") - F.col("place")).alias("start")).agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    starts = placed.filter("n = needed").groupBy("rid").agg(F.collect_list(F.struct("label", "start")).alias("starts"))
    met = starts.join(scanned.filter("words is not null").select("rid", "words"), "rid")
    cuts = met.select("rid", F.explode(F.transform("starts", lambda s: F.struct(s["label"].alias("label"), _cut(F.col("words"), s["start"], F.element_at(sizes, s["label"])).alias("cut")))).alias("c"))
    verified = cuts.select("rid", F.col("c.label").alias("label"), _share(F.col("c.label"), F.col("c.cut"), notices).alias("share")).filter("share is not null")
    more = verified.groupBy("rid").agg(F.collect_set("label").alias("notice_labels"), F.max("share").alias("share"))

    joined = scanned.drop("words", "rare", "held").join(more, "rid", "left")
    starts = F.concat(*[F.col(f"p{k}") for k in range(len(phrases))])
    base = F.array_distinct(F.concat(*[F.when(F.size(f"p{k}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for k, (_, label) in enumerate(phrases)]))
    out = joined.select("doc_id", "n_words", starts.alias("starts"), base.alias("base"), F.coalesce("notice_labels", F.array().cast("array<string>")).alias("more"), "share")
    return out.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", "more")), ",").alias("labels"),
        F.coalesce("share", F.when(F.size("starts") > 0, 0.5).otherwise(0.0)).alias("score"),
    )
