"""Toxicity: a Levenshtein automaton run over a trie of learned terms, and scores of the words around each hit."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, fresh, materialize, new_column, ship

#: Labelled rows that the lexicon is learned from, drawn by hash; the only sample here.
TRAIN_ROWS = 20_000
#: Longer words are no terms; this bounds the depth of the trie.
LONGEST = 48
#: So many clean or toxic uses, dealt as the labels are, stand against what the misspellings show.
NEAR_PRIOR = 2.0
#: Min-hashes of a training text.
SIGNATURES = 8
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
WINDOW = 5
#: Words of a stem are dense where two different ones at least occur, and one in so many words of the text.
DENSE = 200
#: Known words of a worker; the memory is emptied when it has grown to this.
MEMORY_WORDS = 500_000

# Fixed words that mark reported speech, and those that address someone.
REPORTING = "said says say called calls wrote writes quote quoted quoting word term sagte sagt schrieb wort nannte dijo dice llamó palabra dit disait mot appelé".split()
ADDRESSING = "you your youre du dich dein deine ihr tu te toi ton vous usted tú eres".split()
_QUOTES = "\"“”„«»‹›"
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def dense_stems(uses: Counter, total: int) -> set[str]:
    """The stems of which different words cluster in a text of ``total`` words; uses: how often each (stem, word) occurs."""
    different, n = Counter(stem for stem, _ in uses), Counter()
    for (stem, _), k in uses.items():
        if different[stem] > 1:
            n[stem] += k
    return {stem for stem, k in n.items() if k * DENSE >= total}


class Lexicon:
    """Terms in a trie. ``find`` intersects it with the automaton of all words one edit from a word.

    A term is a whole word or a stem (the beginning of words). Words of five letters or more
    match terms of five or more at one insertion, deletion, substitution or swap of neighbours;
    shorter words and stems match as they are. A dense stem counts where its words cluster only.
    """

    def __init__(self, words: list[str], stems: list[str], dense: list[str] = (), seen: set[str] = frozenset()):
        self.seen = seen
        self.words, self.stems = set(words), dict.fromkeys(stems, "stem") | dict.fromkeys(dense, "dense")
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        fuzzy = [w for w in words if len(w) >= 5]
        # One edit leaves the first two or the last two letters as they are; a swap of the middle ones too.
        self.heads, self.tails = {w[:2] for w in fuzzy}, {w[-2:] for w in fuzzy}
        self.lengths = sorted({len(s) for s in self.stems})
        self.longest = max((len(w) for w in fuzzy), default=0)

    def near(self, word: str) -> list[str]:
        """Terms at one edit exactly. A state of the automaton is a row of edit distances, one for each trie node."""
        found = []

        def walk(node: dict, row: list[int], before: list[int] | None, last: str) -> None:
            if "" in node and row[-1] == 1 and len(node[""]) >= 5:
                found.append(node[""])
            for c, child in node.items():
                if not c:
                    continue
                new = [row[0] + 1]
                for j, w in enumerate(word, 1):
                    cost = min(new[j - 1] + 1, row[j] + 1, row[j - 1] + (w != c))
                    if before and j > 1 and c == word[j - 2] and last == w:
                        cost = min(cost, before[j - 2] + 1)
                    new.append(cost)
                if min(new) <= 1:
                    walk(child, new, row, c)

        walk(self.root, list(range(len(word) + 1)), None, "")
        return sorted(found)

    def find(self, word: str) -> tuple[str, str] | None:
        """(term, kind) of a word: kind is word, stem, dense or near; of several near terms the first counts, a misspelling that was seen stands for itself."""
        if word in self.words:
            return word, "word"
        for n in self.lengths:
            if len(word) > n and word[:n] in self.stems:
                return word[:n], self.stems[word[:n]]
        if 5 <= len(word) <= self.longest + 1 and (word[:2] in self.heads or word[-2:] in self.tails) and (near := self.near(word)):
            return word if word in self.seen else near[0], "near"
        return None


@dataclass
class Model:
    """weights: by (term, kind). prior: log odds without hits. context: factors of a weight."""

    weights: dict[tuple[str, str], float] = field(default_factory=dict)  # kind near: of a term's misspellings, or of one misspelling that was seen
    prior: float = -2.0
    context: dict[str, float] = field(default_factory=lambda: {"quoted": 0.2, "plain": 1.0, "addressed": 1.2})

    def lexicon(self) -> Lexicon:
        return Lexicon(*(sorted({t for t, k in self.weights if k == kind}) for kind in ("word", "stem", "dense")), seen={t for t, k in self.weights if k == "near"})

    def without(self, *parts: str) -> Model:
        """The same model without misspellings ("near") or with every context alike ("context")."""
        weights = {k: w for k, w in self.weights.items() if "near" not in parts or k[1] != "near"}
        return Model(weights, self.prior, dict.fromkeys(self.context, 1.0) if "context" in parts else dict(self.context))


class Matcher:
    """Finds the hits of a text. The words that were looked up before are remembered, up to a bound."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.hits, self.clean = lexicon, {}, set()

    def hit_words(self, words: list[str]) -> set[str]:
        distinct = set(words)
        for w in distinct - self.clean - self.hits.keys():
            if found := self.lexicon.find(w):
                self.hits[w] = found
            else:
                self.clean.add(w)
        if len(self.clean) > MEMORY_WORDS:
            self.clean.clear()
        return distinct & self.hits.keys()

    def occurrences(self, text: str | None) -> list[tuple[str, str, str]]:
        """(term, kind, context) of each occurrence; context is quoted, addressed or plain."""
        text = (text or "").lower()
        bad = self.hit_words(_WORD.findall(text))
        if not bad:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b] for a, b in spans]
        dense = dense_stems(Counter((self.hits[w][0], w) for w in words if w in bad and self.hits[w][1] == "dense"), len(words))
        out = []
        for i, w in enumerate(words):
            if w not in bad or self.hits[w][1] == "dense" and self.hits[w][0] not in dense:
                continue
            lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
            around = set(words[lo:i] + words[i + 1 : hi])
            before, after = text[spans[lo][0] : spans[i][0]], text[spans[i][1] : spans[hi - 1][1] + 1]
            quoted = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
            where = "quoted" if quoted or around & _REPORTING and any(q in before + after for q in _QUOTES + "'’") else "addressed" if around & _ADDRESSING else "plain"
            out.append((*self.hits[w], where))
        return out


_REPORTING, _ADDRESSING = frozenset(REPORTING), frozenset(ADDRESSING)


def score_hits(hits: list[tuple[str, str, str]], model: Model) -> float:
    """The chance of label 1: prior odds times the evidence of each distinct term at its strongest context."""
    best: dict[str, float] = {}
    for term, kind, where in hits:
        w = model.weights.get((term, kind), 0.0)
        w *= model.context[where] if w > 0 else 1.0
        best[term] = max(best.get(term, -9.0), w)
    z = model.prior + sum(best.values())
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """identifier, label and text of the training rows: labelled, outside the held-out fold, ``rows`` by hash."""
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).filter("i is not null and y in (0, 1)").filter(fold(F.col("i")) != 0)
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    n = known.count()
    if n > rows:  # the share, not the number, is fixed: the bound holds up to the spread of the hash
        known = known.filter(F.pmod(F.xxhash64("i"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(F.broadcast(known), "i").select("i", "y", "t")


def _signatures(text: str | None) -> list[int]:
    """Min-hashes of the text's four-word shingles; copies that share half of their shingles nearly always agree in two of them."""
    words = words_of(text)
    parts = [" ".join(words[i : i + 4]).encode("utf-8", "surrogatepass") for i in range(max(1, len(words) - 3))]
    hashes = np.fromiter(map(zlib.crc32, parts), np.uint32, len(parts))
    return [int((hashes * np.uint32(0x9E3779B1 + 2 * k) + np.uint32(k) ^ hashes >> 15).min()) for k in range(SIGNATURES)]


def _distinct(train: DataFrame) -> DataFrame:
    """y and t of the training rows, near copies counted once: the row with the smallest identifier stays.

    A row goes if it agrees with one smaller row in two signatures at least. Each signature only meets
    the smallest identifier that has it, so a group of copies of any size makes no pairs.
    """
    signs = train.select("i", F.posexplode("s").alias("k", "s"))
    least = signs.groupBy("k", "s").agg(F.min("i").alias("least"))
    gone = signs.join(least, ["k", "s"]).filter("least < i").groupBy("i", "least").count().filter("count >= 2").select("i").distinct()
    return train.join(gone, "i", "left_anti").dropDuplicates(["i", "t"]).select("y", "t")


def _choose(candidates: list) -> dict[tuple[str, str], object]:
    """The terms with the strongest evidence that don't cover each other: a stem stands for all words that begin with it."""
    chosen: dict[tuple[str, str], object] = {}
    stems: set[str] = set()
    begins: set[str] = set()
    for r in sorted(candidates, key=lambda r: (-r.evidence, r.kind != "word", -len(r.term), r.term)):
        covered = any(r.term[:n] in stems for n in STEM_LENGTHS if n <= len(r.term))
        if covered or r.kind != "word" and r.term in begins:
            continue
        chosen[r.term, r.kind] = r
        begins.update(r.term[:n] for n in STEM_LENGTHS if n <= len(r.term))
        if r.kind != "word":
            stems.add(r.term)
    return chosen


def near_weights(weights: dict[tuple[str, str], float], seen: list, toxic: int, clean: int) -> dict[tuple[str, str], float]:
    """Weights of the misspellings of each term, and of those seen; seen: rows term (a word one edit from a term), y and n documents.

    A word that is near a term by chance occurs in clean texts as often as in toxic ones. What a misspelling never seen
    is worth is told by those seen in one document only: their log odds, against NEAR_PRIOR uses dealt as the labels
    are. One seen more often has its own odds against those. None weighs more than its term or less than nothing.
    """
    count: dict[str, list[int]] = {}
    for r in seen:
        count.setdefault(r.term, [0, 0])[r.y] += r.n
    once = [sum(c[y] for c in count.values() if sum(c) == 1) for y in (0, 1)]
    share = toxic / (toxic + clean)
    bad, good = once[1] + NEAR_PRIOR * share, once[0] + NEAR_PRIOR * (1 - share)
    unseen = math.log(bad / good) - math.log(toxic / clean)
    out = {(t, "near"): max(0.0, min(w, unseen)) for (t, kind), w in weights.items() if kind == "word"}
    for word, (n0, n1) in count.items():
        if n0 + n1 > 1:
            own = math.log((n1 + NEAR_PRIOR * bad / (bad + good)) / (n0 + NEAR_PRIOR * good / (bad + good))) - math.log(toxic / clean)
            out[word, "near"] = max(0.0, min(6.0, own))
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Learn terms, weights and the worth of contexts from labelled rows outside the held-out fold.

    Terms and weights come from document counts by label, near copies counted once. A term is a word, a
    stem, or a stem of which several words cluster (a lone one may begin alike by chance). It is
    taken if its likelihood ratio against the share of toxic rows is beyond what the best of all
    terms would show by chance; its weight is its log odds. The lexicon has all such terms of the sample. Labels that are neither 0 nor 1 are left
    out; of contrary labels 1 counts. Without labelled rows there are no terms and all scores are low.
    """
    ship(docs.sparkSession)

    @F.pandas_udf("array<long>")
    def signed(texts: pd.Series) -> pd.Series:
        return pd.Series([_signatures(t) for t in texts])

    train = materialize(_sample(docs, labels, id_col, text_col, rows).withColumn("s", signed("t")), "train")
    train = materialize(_distinct(train), "distinct")
    size = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    model = Model(prior=min(-1.0, math.log((toxic + 1) / (clean + 1))))
    if not toxic or not clean:
        return model

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            count: Counter = Counter()
            for y, text in zip(batch["y"], batch["t"]):
                words = Counter(words_of(text))
                count.update((w, "word", y) for w in words if 2 < len(w) <= LONGEST)
                for n in STEM_LENGTHS:
                    uses = Counter({(w[:n], w): k for w, k in words.items() if len(w) > n})
                    count.update((s, "stem", y) for s in {s for s, _ in uses})
                    count.update((s, "dense", y) for s in dense_stems(uses, words.total()))
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["term", "kind", "y", "n"])

    share = toxic / (toxic + clean)
    counts = train.select("y", "t").mapInPandas(terms, "term string, kind string, y int, n long").groupBy("term", "kind").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    counts = materialize(counts, "terms")
    beyond_chance = math.log(counts.count() + 1) + 2
    of_all = F.col("bad") / (F.col("bad") + F.col("good"))
    evidence = F.col("bad") * F.log(of_all / share) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - of_all) / (1 - share))).otherwise(0.0)
    odds = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    strong = counts.filter("bad >= 3").withColumns({"evidence": evidence, "w": odds}).filter((F.col("w") >= 3) & (F.col("evidence") > beyond_chance))
    chosen = _choose(strong.collect())
    model.weights = {k: r.w for k, r in chosen.items()}

    sent = train.sparkSession.sparkContext.broadcast(model)

    def uses(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = sent.value.lexicon()
        matcher = Matcher(lexicon)
        for batch in batches:
            count: Counter = Counter()
            for y, text in zip(batch["y"], batch["t"]):
                count.update((t, k, c, y) for t, k, c in set(matcher.occurrences(text)) if k != "near")
                count.update((w, "near", "", y) for w in set(words_of(text)) if matcher.hits.get(w, ("", ""))[1] == "near")
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["term", "kind", "context", "y", "n"])

    seen = train.select("y", "t").mapInPandas(uses, "term string, kind string, context string, y int, n long").groupBy("term", "kind", "context", "y").agg(F.sum("n").alias("n")).collect()
    model.weights |= near_weights(model.weights, [r for r in seen if r.kind == "near"], toxic, clean)
    for where in ("quoted", "addressed"):
        of = lambda y, where=where: sum(r.n for r in seen if (r.context, r.y) == (where, y) and r.kind != "near")
        if of(0) + of(1) >= 20:  # enough uses to learn what the context is worth
            gain = math.log((of(1) + 0.5) / (toxic + 1)) - math.log((of(0) + 0.5) / (clean + 1))
            exact = [w for (_, kind), w in model.weights.items() if kind == "word"]
            mean = sum(exact) / max(1, len(exact)) or 1.0
            model.context[where] = min(1.2, max(0.2, gain / mean))
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", to: str = "toxicity") -> DataFrame:
    """docs with the chance of label 1 in the new column ``to``, which docs must not have (ValueError).

    Null and empty texts get the chance of a text without hits. Repeated rows each give a row, an empty table an empty
    result. A text is scored whole; what is held besides it is its words and their hits.
    """
    new_column(docs, to)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        matcher = Matcher(model.lexicon())
        for texts in batches:
            yield pd.Series([score_hits(matcher.occurrences(t), model) for t in texts], dtype="float64")

    return docs.withColumn(to, of(F.col(text_col).cast("string")))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """The documents that score below the threshold, with all their columns.

    Rows repeat as they are; an empty table gives an empty result.
    """
    (to,) = fresh(docs, "toxicity")
    return score(docs, fit(docs, labels, **options), options.get("text_col", "text"), to).filter(F.col(to) < threshold).drop(to)
