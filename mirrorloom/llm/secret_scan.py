"""Secret scans: fixed patterns, and a lexer of assignments that follows constants to sensitive names."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_column, ship

#: The kinds of spans: those of the fixed patterns, then a literal that a sensitive name is given, then one that reaches such a name through other names.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "literal", "const")
THRESHOLD = 0.5

# Patterns and least lengths of the contract.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run is taken whole, so shorter ones needn't match
_LEAST = {"assign": 6, "access": 20}

# The lexer. Names and blanks are matched possessively and only from where a name can begin, so no text is read twice.
_NAME = r"[$@]{0,2}[A-Za-z_][A-Za-z0-9_.\-]*+"
_TARGET = re.compile(rf"""(?<![A-Za-z0-9_.$@\-])-*+({_NAME})(?:["']?\]|["'])?[ \t]*+(?::=|=>|=(?![=~])|:(?![:=/])|>(?=[^<>\n]*+</))[ \t]*+""")
#: One term of a value: a quoted literal, a name that is looked up, or a bare literal.
_TERM = re.compile(
    r"""[rbfuRBFU]{0,2}(?:'''(?P<t1>(?:[^'\\]|\\.|'(?!''))*+)'''|\"\"\"(?P<t2>(?:[^"\\]|\\.|"(?!""))*+)\"\"\"|'(?P<q1>(?:[^'\\\n]|\\.)*+)'|"(?P<q2>(?:[^"\\\n]|\\.)*+)"|`(?P<q3>[^`\n]*+)`)|(?P<ref>\$\{\{?[ ]?[A-Za-z_][A-Za-z0-9_.]*+[ ]?\}\}?)|(?P<bare>[^\s,;"'`<>(){}\[\]#]++)""",
    re.DOTALL,
)
_JOIN = re.compile(r"[ \t]*+(?:\+|\.\.|\|\|)[ \t]*+\n?[ \t]*+")
_LOOKUP = re.compile(r"\$?\{\{?[ ]?([A-Za-z_][A-Za-z0-9_.]*)[ ]?\}?\}|\$([A-Za-z_][A-Za-z0-9_]*)|%\(([A-Za-z_]\w*)\)s")
_IS_NAME = re.compile(r"[$@]{0,2}[A-Za-z_][A-Za-z0-9_.]*")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: How sensitive a target's words are (own vocabulary): single words, and pairs of neighbours.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.8, "credentials": 0.8, "auth": 0.6, "bearer": 0.8}
PAIRS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 0.9, ("secret", "key"): 1.0, ("encryption", "key"): 0.9, ("signing", "key"): 0.9, ("account", "key"): 0.8, ("connection", "string"): 0.6}
#: A last word that names something about the secret rather than the secret itself.
ABOUT = frozenset("length len size count limit min max field label name type format policy hint url uri path file dir id expiry expires ttl age prompt title column header regex pattern reset help".split())
#: Literals that only hold a place.
PLACEHOLDER = re.compile(r"(?i)(?:x{3,}|\*{3,}|\.{3,}|<.*>|change.?me|example.*|your.*|todo|redacted|placeholder|dummy|sample|test|none|null|nil|undefined|true|false|required|optional|string|n/a)")


def sensitivity(name: str) -> float:
    """0 to 1: how much the words of a target's name (camel case, underscores, dots, dashes) speak of a secret."""
    words = [w.lower() for w in _WORD.findall(name)]
    if not words or words[-1] in ABOUT:
        return 0.0
    return max([SENSITIVE.get(w, 0.0) for w in words] + [PAIRS.get(p, 0.0) for p in zip(words, words[1:])])


#: So many characters of both ends of a value are kept as they are; no placeholder of a fixed length is as long as both.
_END = 64


class Told(NamedTuple):
    """What the quality of a value needs to know of it, however often its parts are repeated: that of a joined value follows from its parts'."""

    size: int  #: its characters, in units of 2 ** unit
    unit: int
    counts: dict[str, int]  #: of each character, in the order of the first places, in the same units
    head: str
    tail: str
    blank: bool  #: white space alone, or empty
    inside: bool  #: white space between other characters


def told(value: str) -> Told:
    inside = any(c.isspace() for c in value.strip())
    return Told(len(value), 0, dict(Counter(value)), value[:_END], value[-_END:], not value.strip(), inside)


def joined(parts: list[Told]) -> Told:
    """What is told of the parts in a row. Sizes beyond 256 bits are rounded to 128, so that values may double without end."""
    if len(parts) == 1:
        return parts[0]
    unit = max((p.unit for p in parts), default=0)
    size, counts, head, tail, blank, inside = 0, {}, "", "", True, False
    for p in parts:
        for c, n in p.counts.items():
            counts[c] = counts.get(c, 0) + (n >> unit - p.unit)
        inside = inside or p.inside or not blank and not p.blank and (tail[-1].isspace() or p.head[0].isspace())
        size, blank = size + (p.size >> unit - p.unit), blank and p.blank
        head, tail = (head + p.head)[:_END] if len(head) < _END else head, (tail + p.tail)[-_END:]
    if size.bit_length() > 256:
        more = size.bit_length() - 128
        size, unit, counts = size >> more, unit + more, {c: n >> more for c, n in counts.items()}
    return Told(size, unit, counts, head, tail, blank, inside)


def quality(of: Told) -> float:
    """0 to 1: how much a value looks like a secret: not short, no placeholder, no sentence, many different characters of several kinds."""
    n = of.size
    if n <= 2 * _END:
        shown = of.head + of.tail[max(0, 2 * _END - n) :] if n > _END else of.head
    else:  # a placeholder of any length is known by its ends and by which characters it has
        shown = of.head + "".join(of.counts) + of.tail
    if n < 6 or of.inside or PLACEHOLDER.fullmatch(shown):
        return 0.0
    shares = [c / n for c in of.counts.values()]
    bits = -sum(s * math.log2(s) for s in shares if s)
    kinds = sum(any(map(test, of.counts)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, 0.3 + 0.1 * bits + 0.1 * kinds)


def literal_quality(value: str) -> float:
    """The quality of one literal."""
    return quality(told(value))


class _Joined:
    """A value that is joined from literals and other values; what is told of it is found once it is asked for, then its parts are let go."""

    __slots__ = ("known", "parts")

    def __init__(self, parts: list[str | _Joined]):
        self.parts, self.known = parts, None

    def told(self) -> Told:
        stack = [self]
        while stack:
            top = stack[-1]
            open_ = [] if top.known else [p for p in top.parts if isinstance(p, _Joined) and not p.known]
            if open_:
                stack += open_
                continue
            if not top.known:
                top.known, top.parts = joined([told(p) if isinstance(p, str) else p.known for p in top.parts]), []
            stack.pop()
        return self.known


def _let_go(held: list) -> Iterator[tuple[str, int, int]]:
    """The literals below a list of literals and such lists, in order. Each list is emptied behind: its literals are found now."""
    stack = [(held, iter(held))]
    while stack:
        below, rest = stack[-1]
        for x in rest:
            if isinstance(x, list):
                stack.append((x, iter(x)))
                break
            yield x
        else:
            below.clear()
            stack.pop()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and not overlapping within a kind, those too short dropped."""
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= _LEAST["access"]]
    return out + [("hex", *m.span()) for m in _HEX.finditer(text)]


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, str, int, int]]]]:
    """The assignments of a text in their order: the target's name, and the terms of its value.

    A term is (kind, text, start, end), its kind ``literal`` (quoted, without the quotes), ``bare`` (a word that may be a name or a
    literal) or ``lookup`` (a name inside a quoted literal: ``${NAME}``, ``{NAME}``, ``$NAME``, ``%(NAME)s``, or ``${NAME}`` alone). Terms are joined by
    ``+``, ``..`` or ``||``. Read are ``name = value``, ``name: value``, ``name := value``, ``"name" => value``, ``["name"] = value``, ``--name=value`` and ``<name>value</name>``.
    A bare word may hold targets itself (``a=b=c``): the target before it has the whole word, each in it what stands before the next one.
    """
    at, reach = 0, 0
    m = _TARGET.search(text)
    while m:
        ahead = _TARGET.search(text, m.end()) if m.start() < reach else None
        if ahead and ahead.start() < reach:
            yield m[1], [("bare", text[m.end() : ahead.start()], m.end(), ahead.start())]
            m = ahead
            continue
        terms, at = [], m.end()
        while t := _TERM.match(text, at):
            at, group = t.end(), t.lastgroup
            if group != "ref":
                terms.append(("bare" if group == "bare" else "literal", t[group], *t.span(group)))
            if group != "bare":
                terms += [("lookup", next(filter(None, x.groups())), t.start(group) + x.start(), t.start(group) + x.end()) for x in _LOOKUP.finditer(t[group])]
            joined = _JOIN.match(text, at)
            if not joined:
                break
            at = joined.end()
        if terms:
            yield m[1], terms
            if terms[-1][0] == "bare":  # it may hold the next target (a: b = c), so the search goes on from its beginning
                at, reach = terms[-1][2:]
        m = _TARGET.search(text, at)


def lexed_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str, float]]:
    """(kind, start, end, target, score) of the literals that sensitive names hold, directly or through constants.

    Constants are followed in the order of the text: a name stands for all literals it was last given, however many; values that hold
    other values refer to them, so nothing is copied. A bare word of letters alone
    is an unknown name or prose, not a literal. The score is the
    target's sensitivity times the quality of the whole value, its literals joined.
    """
    known: dict[str, tuple[list, _Joined]] = {}
    best: dict[tuple[int, int], tuple[str, int, int, str, float]] = {}
    for name, terms in pairs(text):
        held: list = []  # a literal of this value's own, or the list of those that a name holds
        parts: list[str | _Joined] = []
        for kind, value, start, end in terms:
            plain = value.lstrip("$@")
            if kind == "literal":
                held.append((value, start, end))
                parts.append(value)
            elif plain in known and _IS_NAME.fullmatch(value):
                held.append(known[plain][0])
                parts.append(known[plain][1])
            elif kind == "bare" and not (value.rstrip(".:!?").isalpha() or len(terms) > 1 and _IS_NAME.fullmatch(value)):
                held.append((value.rstrip(".:!?"), start, start + len(value.rstrip(".:!?"))))
                parts.append(held[-1][0])
        whole = _Joined(parts)
        known[name.lstrip("$@")] = held, whole
        how = sensitivity(name)
        if not how:
            continue
        score = how * quality(whole.told())
        if score < threshold:
            continue
        own = {x[1:] for x in held if isinstance(x, tuple)}
        for value, start, end in _let_go(held):
            found = ("literal" if (start, end) in own else "const", start, end, name, round(score, 6))
            if value and (start, end) not in best:
                best[start, end] = found
    return list(best.values())


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, str | None, float]]:
    """All spans of a text by start, then kind: (kind, start, end, target, score) in code points, the end exclusive."""
    text = text or ""
    base = [(*s, None, 1.0) for s in base_spans(text)]
    covered = sorted(s[1:3] for s in base)
    out, reach, i = list(base), -1, 0
    for s in sorted(lexed_spans(text, threshold), key=lambda s: s[1:3]):
        while i < len(covered) and covered[i][0] <= s[1]:
            reach, i = max(reach, covered[i][1]), i + 1
        if s[2] > reach:  # not within a span that is found anyway
            out.append(s)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SPANS = "array<struct<kind:string,start:int,end:int,target:string,score:double>>"


def find_secrets(docs: DataFrame, text_col: str = "text", to: str = "secrets", threshold: float = THRESHOLD) -> DataFrame:
    """docs with the new column ``to``: its secrets as (kind, start, end, target, score), by start, then kind as in KINDS.

    The whole text is read, however long, in time linear to it. A null or empty text has an empty list. Repeated rows are scanned
    each, an empty table stays empty, all other columns stay; one named as ``to`` already raises. Each text is
    judged alone, so nothing is shuffled. Literals within a span of the fixed patterns aren't listed again.
    """
    new_column(docs, to)
    ship(docs.sparkSession)

    @F.pandas_udf(SPANS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "target", "score"), s)) for s in scan(t, threshold)] for t in texts], dtype="object")

    return docs.withColumn(to, of(F.col(text_col).cast("string")))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every secret of text_col replaced by ``mark``, overlapping ones by one; null texts stay null."""
    ship(docs.sparkSession)

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else _without(t, mark, threshold) for t in texts], dtype="object")

    return docs.withColumn(text_col, of(F.col(text_col).cast("string")))


def _without(text: str, mark: str, threshold: float) -> str:
    out, at = [], 0
    for _, start, end, _, _ in scan(text, threshold):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])
