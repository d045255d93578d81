"""Token counts of whole texts, from those of the words between proven boundaries; huge texts in overlapping chunks that are spliced where both agree."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_column, ship

#: A text of more characters is encoded in chunks of so many, which overlap.
CHUNK, OVERLAP = 65_536, 512
#: A boundary so near the end of a chunk isn't trusted: what follows may change it.
MARGIN = 64
BATCH_CHARS = 1 << 20
#: A task remembers the counts of words of so many characters together, then begins anew.
KNOWN_CHARS = 1 << 23
#: A space between two characters that are no white space. No piece goes on over it: only white space joins white space, and a piece that
#: begins with the space has what follows it, whatever that is. So a text has the tokens of its words, each after the first with its space.
_CUT = re.compile(r" (?=[\w!-~])(?<=[\w!-~] )")

_READY: dict[tuple[str, int], object] = {}


def load(text: str):
    """The tokenizer of a JSON description; offsets keep the white space that belongs to a token."""
    key = (text[:64], hash(text))
    if key not in _READY:
        import json

        from tokenizers import Tokenizer

        told = json.loads(text)
        cut = told.get("pre_tokenizer") or {}
        if not cut.get("type") == "ByteLevel" or not cut.get("use_regex", True) or told.get("normalizer"):
            raise ValueError("the splice is proven for byte-level tokenizers without a normalizer only")
        if any(a.get("lstrip") or a.get("rstrip") or " " in a["content"] for a in told.get("added_tokens") or ()):
            raise ValueError("added tokens that hold or take in spaces are not supported")
        told["post_processor"] = None
        told["truncation"] = told["padding"] = None
        _READY[key] = Tokenizer.from_str(json.dumps(told))
    return _READY[key]


def _pieces(tokenizer, text: str, start: int) -> tuple[list[int], list[int]]:
    """Where the pre-token pieces of a chunk begin in the whole text, and how many tokens lie before each."""
    encoded = tokenizer.encode(text, add_special_tokens=False)
    begins, before, last = [], [], object()
    for k, ((a, _), word) in enumerate(zip(encoded.offsets, encoded.word_ids)):
        if word != last or word is None:
            begins.append(start + a)
            before.append(k)
            last = word
    begins.append(start + len(text))
    before.append(len(encoded.ids))
    return begins, before


def count_huge(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, margin: int = MARGIN) -> int:
    """Tokens of a text of any length; equal to those of encoding it whole.

    The pieces that the merges work in are matched from left to right, and nothing before
    a piece bears on it. So a boundary between pieces that the left chunk shows well before
    its end is a boundary of the whole text, and where the right chunk has a piece that
    begins there too, all its further pieces are right. Tokens left of the first such place
    count from the left chunk, those right of it from the right one. Where the chunks agree
    nowhere, the overlap doubles, at last to a chunk that begins where the left one does.
    """
    total, at, start, size = 0, 0, 0, chunk  # tokens before ``at``; ``start``: where the next chunk begins
    begins, before = _pieces(tokenizer, text[:size], 0)
    end = min(size, len(text))
    while end < len(text):
        width = overlap
        trusted = {b: n for b, n in zip(begins[:-2], before) if at <= b < end - margin}
        while True:
            start = max(at, end - width)
            far = min(len(text), end + chunk)
            right_begins, right_before = _pieces(tokenizer, text[start:far], start)
            common = next((b for b in right_begins[:-1] if b in trusted), None)
            if common is not None and (common > start or start == at):
                break
            if start == at:  # one piece fills the chunk: it must be seen whole
                far_size = (far - at) * 2
                begins, before = _pieces(tokenizer, text[at : at + far_size], at)
                right_begins = None
                break
            width *= 2
        if right_begins is None:
            end = min(len(text), at + far_size)
            continue
        base = before[begins.index(at)] if at in trusted or at in begins else 0
        total += trusted[common] - base
        at, begins, before, end = common, right_begins, right_before, far
    base = before[begins.index(at)]
    return total + before[-1] - base


class Words:
    """Token counts of texts by their words, remembered from text to text."""

    def __init__(self, tokenizer, most: int = KNOWN_CHARS):
        self.tokenizer, self.most = tokenizer, most
        self.known: dict[str, int] = {}  # of a word with a space before it
        self.chars = 0

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if self.chars > self.most:
            self.known.clear()
            self.chars = 0
        parts = [_CUT.split(t) for t in texts]
        out = self.encode([p[0] for p in parts])
        new = list({w for p in parts for w in p[1:]} - self.known.keys())
        self.known.update(zip(new, self.encode([f" {w}" for w in new])))
        self.chars += sum(map(len, new))
        return [n + sum(map(self.known.__getitem__, p[1:])) for n, p in zip(out, parts)]


def count_tokens(docs: DataFrame, tokenizer_file: str, text_col: str = "text", to: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """docs with the number of tokens in the new column ``to`` (ValueError if docs has it), as the tokenizers library gives it for the file.

    No begin, end or added special tokens; the strings of special tokens inside texts count
    as the library takes them by default. Null and empty texts have none. The file's content
    (a few MB, whatever the data) is broadcast. Texts of up to ``chunk`` characters are
    counted in batches, each different word once, longer ones are encoded in overlapping chunks, so memory is bounded by the batch.
    Repeated rows each give a row, an empty table an empty result.
    """
    new_column(docs, to)
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_file).read_text(encoding="utf-8"))

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = load(sent.value)
        words = Words(tokenizer)
        for texts in batches:
            counts = [0] * len(texts)
            held: list[tuple[int, str]] = []
            size = 0

            def flush() -> None:
                for (i, _), n in zip(held, words.count([t for _, t in held])):
                    counts[i] = n
                held.clear()

            for i, t in enumerate(texts):
                if not t:
                    continue
                if len(t) > chunk:
                    counts[i] = count_huge(tokenizer, t, chunk, overlap)
                    continue
                held.append((i, t))
                size += len(t)
                if size > BATCH_CHARS:
                    flush()
                    size = 0
            flush()
            yield pd.Series(counts, dtype="int64")

    return docs.withColumn(to, of(F.col(text_col).cast("string")))
