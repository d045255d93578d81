"""Scores of a log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model predicts one of a fixed number of outcomes from the two before: the end of a text,
each of the most frequent words, or a class of the other words (by the hash of a word's last two
bytes). Within a class a word has its smoothed share of the class's training tokens, so the
probabilities of all words sum to one. All counts are taken over the whole training part.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, materialize, ship

TOP, CLASSES, DIM = 79, 48, 24
OUTCOMES = 1 + TOP + CLASSES
#: Words of at least this share of the training tokens (so a million at most) are known to each Python worker; the
#: counts of all others are joined.
FREQUENT = 1e-6
FLUSH = 400_000
#: Documents of one step of scoring.
SLICE = 400
SHARDS, ROUNDS, STEPS, BATCH, NOISE = 4, 2, 500, 4096, 64
#: Each of ROUNDS draws so large a share of the training tokens at least, so training follows the input; STEPS a shard are the least.
DRAWN = 0.125
END = b""


def tokens_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def class_of(word: bytes) -> int:
    return 1 + TOP + zlib.crc32(word[-2:]) % CLASSES


def class_column(word: Column) -> Column:
    return (1 + TOP + F.crc32(F.substring(word, -2, 2)) % CLASSES).cast("int")


# -- counts -----------------------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary, empty for the end of a text) and c over the column t; counted in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(tokens_of(text.as_py()))
                seen[END] += 1
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    return texts.select("t").mapInArrow(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Ids:
    """Outcome numbers of words; words that were looked up are remembered, up to a bound."""

    def __init__(self, top: list[bytes]):
        self.fixed = {END: 0} | {w: k for k, w in enumerate(top, 1)}
        self.known = dict(self.fixed)

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.known.get
        out = [get(w, -1) for w in words]
        if -1 in out:
            for i, k in enumerate(out):
                if k < 0:
                    out[i] = self.known[words[i]] = class_of(words[i])
            if len(self.known) > FLUSH:
                self.known = dict(self.fixed)
        return np.array(out, np.int64)


def _contexts(ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The outcomes one and two before each; texts begin after an end."""
    one = np.concatenate([[0], ids[:-1]])
    two = np.concatenate([[0, 0], ids[:-2]])[: len(ids)]
    two[starts] = 0
    return one, two


def outcome_counts(texts: DataFrame, top: list[bytes]) -> DataFrame:
    """code and n: how often each outcome follows each pair; at most OUTCOMES ** 3 rows, whatever the input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = Ids(top), np.zeros(OUTCOMES**3, np.int64)
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                parts = [ids.of([*tokens_of(text.as_py()), END]) for text in whole.column(0).slice(first, SLICE)]
                flat = np.concatenate(parts)
                one, two = _contexts(flat, np.cumsum([0, *map(len, parts[:-1])]))
                code, n = np.unique((two * OUTCOMES + one) * OUTCOMES + flat, return_counts=True)
                total[code] += n
        code = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(total[code], pa.int64())], ["code", "n"])

    return texts.select("t").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


# -- the model --------------------------------------------------------------------------------


@dataclass
class LogBilinear:
    """Predicted vector: near * inputs[one before] + far * inputs[two before]; score: its product with outputs, plus bias."""

    inputs: np.ndarray
    outputs: np.ndarray
    bias: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray, dim: int = DIM, seed: int = 7) -> LogBilinear:
        rng = np.random.default_rng(seed)
        n = len(unigram)
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(small(n, dim), small(n, dim), np.log(unigram).astype(np.float32), np.ones(dim, np.float32), np.full(dim, 0.5, np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.inputs, self.outputs, self.bias, self.near, self.far]

    def pack(self) -> bytes:
        return np.concatenate([p.ravel() for p in self.parts()]).astype(np.float32).tobytes()

    def unpack(self, data: bytes) -> LogBilinear:
        flat, out, at = np.frombuffer(data, np.float32), [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).copy())
            at += p.size
        return LogBilinear(*out)

    def log_probabilities(self) -> np.ndarray:
        """Normalised log10 probabilities [two before, one before, outcome], a matrix product for each outcome two before."""
        n = len(self.bias)
        table = np.empty((n, n, n), np.float32)
        for two in range(n):
            s = (self.inputs * self.near + self.inputs[two] * self.far) @ self.outputs.T + self.bias
            s -= s.max(axis=1, keepdims=True)
            table[two] = (s - np.log(np.exp(s).sum(axis=1, keepdims=True))) / math.log(10)
        return table


def train_nce(model: LogBilinear, code: np.ndarray, n: np.ndarray, unigram: np.ndarray, steps: int = STEPS, batch: int = BATCH, noise: int = NOISE, rate: float = 0.08, seed: int = 0) -> LogBilinear:
    """Noise-contrastive estimation with Adagrad on outcomes drawn by their counts; a batch shares its noise."""
    rng = np.random.default_rng(seed)
    ends, size = np.cumsum(n), len(unigram)
    log_noise = np.log(unigram * noise).astype(np.float32)
    cdf = np.cumsum(unigram)
    grown = [np.full_like(p, 1e-3) for p in model.parts()]
    eye = np.eye(size, dtype=np.float32)
    sigma = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(steps):
        drawn = code[np.searchsorted(ends, rng.random(batch) * ends[-1], side="right").clip(max=len(code) - 1)]
        w, one, two = drawn % size, drawn // size % size, drawn // size**2
        false = np.searchsorted(cdf, rng.random(noise) * cdf[-1], side="right").clip(max=size - 1)
        a, b = model.inputs[one], model.inputs[two]
        h = a * model.near + b * model.far
        q, qf = model.outputs[w], model.outputs[false]
        true_g = 1 - sigma((h * q).sum(1) + model.bias[w] - log_noise[w])
        false_g = -sigma(h @ qf.T + model.bias[false] - log_noise[false])
        dh = true_g[:, None] * q + false_g @ qf
        hot_w, hot_false = eye[w], eye[false]
        grads = [
            eye[one].T @ (dh * model.near) + eye[two].T @ (dh * model.far),
            hot_w.T @ (true_g[:, None] * h) + hot_false.T @ (false_g.T @ h),
            hot_w.T @ true_g + hot_false.T @ false_g.sum(0),
            (dh * a).sum(0),
            (dh * b).sum(0),
        ]
        for p, g, acc in zip(model.parts(), grads, grown):
            g = g / batch
            acc += g * g
            p += (rate * (1 - step / steps) + 1e-3) * g / np.sqrt(acc)
    return model


def train(counts: DataFrame, unigram: np.ndarray, shards: int = SHARDS, rounds: int = ROUNDS, steps: int = STEPS) -> LogBilinear:
    """Each shard of the outcome counts trains from the common state; the states are averaged by their counts after each round."""
    model = LogBilinear.start(unigram)
    dealt = counts.withColumn("shard", F.pmod(F.xxhash64("code"), F.lit(shards)).cast("int"))
    for r in range(rounds):
        state = model.pack()

        def work(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:  # runs within this round
            rows = rows.sort_values("code")
            own = LogBilinear.start(unigram).unpack(state)
            own = train_nce(own, rows["code"].to_numpy(), rows["n"].to_numpy(), unigram, steps, seed=1000 * r + key[0])
            return pd.DataFrame({"n": [int(rows["n"].sum())], "state": [own.pack()]})

        states = dealt.groupBy("shard").applyInPandas(work, "n long, state binary").collect()  # one small row a shard
        if not states:
            break
        total = sum(s.n for s in states)
        mean = sum(np.frombuffer(bytes(s.state), np.float32).astype(np.float64) * (s.n / total) for s in sorted(states, key=lambda s: bytes(s.state)))
        model = model.unpack(mean.astype(np.float32).tobytes())
    return model


# -- scoring ----------------------------------------------------------------------------------

_SCORED = "rid long, doc_id {id}, held_out boolean, n_tokens long, known long, log_counts double, score double, rest array<struct<w:binary,n:long>>"


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: float = FREQUENT, steps: int = STEPS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the documents outside the held-out fold; scores all. Tokens are the words
    and one end. Null and empty texts are an end alone. base_score: smoothed unigram; score: the
    model's log10 probability. Repeated rows each give a row; null identifiers are in the fold of the empty
    text. Without training documents all words are unknown. Words below the share ``frequent``
    of the training tokens meet their counts in a join, so no worker holds the vocabulary; the share only moves work, not results.
    An empty table gives an empty result. Only the two named columns are read, so others may have any names. SLICE
    texts' words are held at a time, so the longest text bounds the memory.
    """
    ship(docs.sparkSession)
    held = fold(F.col(id_col)) == 1
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"), held.alias("held_out"))
    training = base.filter(~F.col("held_out"))
    counts = materialize(word_counts(training), "counts")
    n_train, v_train = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    most = counts.filter(F.length("word") > 0).orderBy(F.desc("c"), "word").limit(TOP)  # the outcomes of their own, whatever the share
    best = {bytes(r.word): r.c for r in counts.filter(F.col("c") >= frequent * n_train).unionByName(most).collect()}
    best = sorted(best.items(), key=lambda x: (-x[1], x[0]))
    top = [w for w, _ in best if w != END][:TOP]
    fixed = {END: 0} | {w: k for k, w in enumerate(top, 1)}
    # The training tokens of each outcome, and the distinct words of each class.
    sums = {k: [0, 0] for k in range(OUTCOMES)}
    for r in counts.groupBy(class_column(F.col("word")).alias("k")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
        sums[r.k] = [r.n, r.v]
    for w, c in best:
        if w in fixed:
            sums[class_of(w)][0] -= c
            sums[class_of(w)][1] -= 1
            sums[fixed[w]] = [c, 1]
    unigram = np.array([sums[k][0] + 0.5 for k in range(OUTCOMES)])
    unigram /= unigram.sum()
    steps = max(steps, math.ceil(DRAWN * n_train / (SHARDS * BATCH)))
    model = train(materialize(outcome_counts(training, top), "outcomes"), unigram, steps=steps)
    log_rare = np.array([math.log10(sums[k][0] + 0.5 * (sums[k][1] + 1)) if k > TOP else 0.0 for k in range(OUTCOMES)])
    sent = docs.sparkSession.sparkContext.broadcast((model, best, top, log_rare))

    schema = _SCORED.format(id=base.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, best, top, log_rare = sent.value
        table = model.log_probabilities()
        fixed = {END: 0} | {w: k for k, w in enumerate(top, 1)}
        number = {w: i for i, (w, _) in enumerate(best)}
        # By number: log10(c + 0.5) and outcome; the last two rows are an unseen end and a word to be joined.
        log_c = np.array([math.log10(c + 0.5) for _, c in best] + [math.log10(0.5), 0.0])
        outcome = np.array([fixed.get(w, -1) if w in fixed else class_of(w) for w, _ in best] + [0, -1])
        end, rest_of = number.get(END, len(best)), len(best) + 1
        known = np.array([1] * len(best) + [0, 0])
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):  # bounds the memory, as each token is a Python object here
                batch = whole.slice(first, SLICE)
                flat: list[int] = []
                starts, late, rest_ends = [], [], [0]
                rest_words: list[bytes] = []
                rest_counts: list[int] = []
                for text in batch.column("t"):
                    starts.append(len(flat))
                    words = tokens_of(text.as_py())
                    own = [number.get(w, rest_of) for w in words]
                    rest = Counter(w for w, k in zip(words, own) if k == rest_of)
                    if rest:
                        classes = {w: class_of(w) for w in rest}
                        late += [(len(flat) + i, classes[words[i]]) for i, k in enumerate(own) if k == rest_of]
                        rest_words += rest.keys()
                        rest_counts += rest.values()
                    rest_ends.append(len(rest_words))
                    flat += own
                    flat.append(end)
                num, at = np.array(flat), np.array(starts)
                ids = outcome[num]
                if late:
                    where, which = map(np.array, zip(*late))
                    ids[where] = which
                one, two = _contexts(ids, at)
                # The end of a text has its own outcome even if no training text was seen.
                log_p = table[two, one, ids].astype(np.float64) + np.where(ids > TOP, log_c[num] - log_rare[ids], 0.0)
                pairs = pa.StructArray.from_arrays([pa.array(rest_words, pa.binary()), pa.array(rest_counts, pa.int64())], ["w", "n"])
                sums = [pa.array(np.add.reduceat(x, at)) for x in (known[num], log_c[num], log_p)]
                arrays = [batch.column("rid"), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff([*starts, len(flat)]), pa.int64()), *sums, pa.ListArray.from_arrays(pa.array(rest_ends, pa.int32()), pairs)]
                yield pa.RecordBatch.from_arrays(arrays, ["rid", "doc_id", "held_out", "n_tokens", "known", "log_counts", "score", "rest"])

    numbered = base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "t")
    scored = materialize(numbered.mapInArrow(run, schema), "scored")  # written, so that rid stays the same
    rest = scored.select("rid", F.explode("rest").alias("r")).select("rid", F.col("r.w").alias("word"), F.col("r.n").alias("n"))
    joined = rest.join(counts, "word", "left")
    more = joined.groupBy("rid").agg(F.sum(F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    all_of = scored.drop("rest").join(more, "rid", "left")
    more_log, log_n = F.coalesce("more", F.lit(0.0)), math.log10(n_train + 0.5 * (v_train + 1))
    return all_of.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("log_counts") + more_log - F.col("n_tokens") * F.lit(log_n)).alias("base_score"),
        (F.col("score") + more_log).alias("score"),
    )
