"""Secret scan by a trigram index.

A Boolean trigram query is derived from each rule's regular expression: the AND over its mandatory literal runs of the
AND of their trigrams, the OR over alternatives. For each slice of texts an inverted index of the trigrams that any
query names is made (posting list: a bit for each text), the queries are evaluated on the postings, and only the
candidates are searched with the regular expression. A rule without a mandatory trigram scans every text in full;
a rule that is one class repeated does that by runs of the class's bytes, which gives the same matches.

Texts are compared whole, lower-cased (A-Z) for the index, so rules of either case use the same postings. Matches are
those of the expression, leftmost and non-overlapping for each rule; a match that fails the rule's length test is
dropped after it has taken its text. Spans count code points, the end is exclusive; those that start together are in the
order of the rules. Nulls, empty texts: no spans. Long texts are searched whole, in time that grows with their length.
Repeated rows are searched each. An empty table gives no rows. An input column whose name (in any case) is that of the spans
is replaced by them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from re import _constants as sre  # Python's own parser of regular expressions
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodestone.llm import textbuf



@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0  # characters of the group
    ignore_case: bool = False
    skip: str = ""  # of a rule without a group: tried where the pattern fails; no match may start within what it takes

    def compiled(self):
        return self._compiled(self.pattern)

    def _compiled(self, pattern: str):
        return re.compile(pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))

    def matches(self, text: str):
        """The matches of the pattern, without those that fail the length test."""
        found = self._compiled(f"({self.pattern})|{self.skip}" if self.skip else self.pattern).finditer(text)
        return (m for m in found if (m.lastindex or not self.skip) and m.end(self.group) - m.start(self.group) >= self.least)


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: Rules beyond the base ones.
MORE = (
    # up to the END line if no other run of five hyphens comes before it, else the BEGIN line alone
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----)?"),
    Rule("code_host", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    # a run in which the first eyJ starts no token has none: without the skip, eyJeyJeyJ... takes quadratic time
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", skip=r"eyJ[A-Za-z0-9_-]*"),
    Rule("url_login", r"://[^\x00-\x20:/@]+:[^\x00-\x20:/@]+@"),
)
RULES = BASE + MORE
#: More strings than these are not written out; the query is then less strict.
MOST_STRINGS = 64

Query = tuple | str | None  # ("and" | "or", parts), a trigram, or None: every text


def _join(kind: str, parts: list) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    parts = sorted({p for p in parts if p is not None}, key=repr)
    return None if not parts else parts[0] if len(parts) == 1 else (kind, tuple(parts))


def _of_strings(strings: set[str]) -> Query:
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


def _strings(item) -> set[str] | None:
    """All strings that this part of a pattern can match, lower-cased; None: not few."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        out = set()
        for kind, x in arg:
            if kind is sre.LITERAL:
                out.add(chr(x).lower())
            elif kind is sre.RANGE and x[1] - x[0] < 8:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[-1])
    if op is sre.BRANCH:
        sets = [_sequence(b) for b in arg[1]]
        return None if any(s is None for s in sets) else set().union(*sets)
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 2:
        one = _sequence(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for n in range(int(arg[1]) + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
        return out if len(out) <= MOST_STRINGS else None
    return {""} if op is sre.AT else None


def _sequence(items) -> set[str] | None:
    out = {""}
    for item in items:
        s = _strings(item)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(items) -> Query:
    """The query that every text with a match fulfils; items: a parsed pattern."""
    parts, run = [], {""}
    for item in items:
        s = _strings(item)
        if s is not None and len(run) * len(s) <= MOST_STRINGS:
            run = {a + b for a in run for b in s}
            continue
        parts.append(_of_strings(run))
        run = s if s is not None and len(s) <= MOST_STRINGS else {""}
        if s is None:
            op, arg = item
            if op is sre.SUBPATTERN:
                parts.append(trigram_query(arg[-1]))
            elif op is sre.BRANCH:
                parts.append(_join("or", [trigram_query(b) for b in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                parts.append(trigram_query(arg[2]))
    return _join("and", [*parts, _of_strings(run)])


def trigrams(q: Query) -> set[str]:
    return set() if q is None else {q} if isinstance(q, str) else set().union(*map(trigrams, q[1]))


def class_bytes(pattern: str) -> np.ndarray | None:
    """Of a pattern that is one ASCII class, once or more: its bytes; else None."""
    p = list(parser.parse(pattern))
    if len(p) != 1 or p[0][0] is not sre.MAX_REPEAT or p[0][1][0] != 1 or p[0][1][1] is not sre.MAXREPEAT or len(p[0][1][2]) != 1 or p[0][1][2][0][0] is not sre.IN:
        return None
    one = re.compile(pattern)
    return np.array([c < 128 and bool(one.fullmatch(chr(c))) for c in range(256)])


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(parser.parse(r.pattern, re.IGNORECASE if r.ignore_case else 0)) for r in rules]
        self.grams = sorted(set().union(*map(trigrams, self.queries)))
        # a gram with characters beyond ASCII has more than three bytes; none of it is looked for
        self.number = {g: k for k, g in enumerate(g for g in self.grams if g.isascii())}
        self.classes = [class_bytes(r.pattern) if q is None and not r.ignore_case and r.group == 0 else None for r, q in zip(rules, self.queries, strict=True)]

    def postings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each trigram, a bit for each text."""
        out = np.zeros((len(self.number), len(offsets) - 1), dtype=bool)
        if len(data) < 3 or not self.number:
            return out
        table = np.full(1 << 15, -1, dtype=np.int16)  # by 5 bits of each byte; then compared in full
        codes = np.array([int.from_bytes(g.encode(), "big") for g in self.number], dtype=np.int64)
        fold = lambda a, b, c: ((a & 31).astype(np.int16) << 10) | ((b & 31).astype(np.int16) << 5) | (c & 31)
        table[fold(codes >> 16, codes >> 8 & 255, codes & 255)] = 0
        at = np.flatnonzero(table[fold(data[:-2], data[1:-1], data[2:])] == 0)
        code = data[at].astype(np.int64) << 16 | data[at + 1].astype(np.int64) << 8 | data[at + 2]
        order = np.argsort(codes)
        k = np.minimum(np.searchsorted(codes[order], code), len(codes) - 1)
        same = codes[order][k] == code
        at, which = at[same], order[k[same]]
        row = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[row + 1]
        out[which[inside], row[inside]] = True
        return out

    def candidates(self, q: Query, postings: np.ndarray) -> np.ndarray:
        if q is None:
            return np.ones(postings.shape[1], dtype=bool)
        if isinstance(q, str):
            return postings[self.number[q]] if q in self.number else np.ones(postings.shape[1], dtype=bool)
        return reduce(np.logical_and if q[0] == "and" else np.logical_or, [self.candidates(p, postings) for p in q[1]])

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule, end), sorted."""
        raw, offsets = textbuf.flat(column)
        postings = self.postings(textbuf.lower_table()[raw], offsets)
        found: list[list] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for k, (rule, query, own) in enumerate(zip(self.rules, self.queries, self.classes, strict=True)):
            if own is not None:
                row, start, end = self.runs(raw, offsets, own, max(1, rule.least))
                if len(row):  # places in code points: those before the run less those before the text
                    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    before = points[start] - points[offsets[row]]
                    for r, b, e in zip(row.tolist(), before.tolist(), (before + end - start).tolist(), strict=True):
                        found[r].append((b, k, e))
                continue
            for r in np.flatnonzero(self.candidates(query, postings)).tolist():
                if (text := texts.get(r)) is None:
                    text = texts[r] = column[r].as_py() or ""
                found[r] += [(m.start(), k, m.end()) for m in rule.matches(text)]
        for f in found:
            f.sort()
        return found

    @staticmethod
    def runs(data: np.ndarray, offsets: np.ndarray, own: np.ndarray, least: int):
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = own[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        long = end - start >= least
        row = np.searchsorted(offsets, start[long], "right") - 1
        return row, start[long], end[long]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_secrets(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, output: str = "secrets", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) of docs with the spans of all rules, by start and then in the order of the rules."""
    scanner = Scanner(rules)
    kinds = [r.kind for r in rules]

    def kernel(column: pa.Array) -> list[pa.Array]:
        spans = [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in f] for f in scanner.scan(column)]
        return [pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))]

    return textbuf.annotate(docs, text, T.StructType([T.StructField(output, SPANS)]), kernel, keep)
