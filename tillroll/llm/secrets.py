"""Secret scans through a trigram inverted index.

Every rule's regex is turned into a Boolean query over trigrams that each match must
contain (AND over what is mandatory, OR over alternatives; letters folded to lower
case).  A batch of texts gets one inverted index: trigram -> texts that hold it, for
the trigrams that the queries name.  The postings are intersected and united as the
query says, and the regex verifies the surviving texts.  A rule without mandatory
trigrams scans every text.

Edge cases: null and empty texts have no spans; an empty table gives an empty result;
repeated rows each get their own (equal) result; texts are read whole, whatever their
length; input columns named like an output column are replaced.  Overlapping spans of
different kinds are all reported; within a kind, matches are leftmost and do not
overlap.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm.arrowtools import append_columns, longs, text_bytes, worker_cache


@dataclass(frozen=True)
class Rule:
    """``group`` 0 or a capture group must have ``min_chars`` characters for a match to count."""

    kind: str
    pattern: str
    group: int = 0
    min_chars: int = 1
    ignore_case: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# A PEM body: header lines, then runs of base64 by any layout (line breaks may be written as \n, lines
# be quoted, indented or commented), short ones only as whole lines, up to the END line if there is one.
# All repeats are possessive, so a scan stays linear.
_LINE_END = r"""["',;+\x20\t\r]*+(?:(?:\\+r)?\\+n["',;+\x20\t\r]*+\n?|\n)[\x20\t>*#|"']*+(?://[\x20\t]++)?+"""
_JUNK = r"""(?:[\s"'>*#|+,;.]|\\+[nrt]?|<br\s*/?>)*+"""
_PEM_BODY = (rf"(?:{_LINE_END}[A-Za-z][A-Za-z0-9-]*:[^\n\\]*+)*+"
             rf"(?:{_JUNK}[A-Za-z0-9+/]{{20,}}+=*+|{_LINE_END}[A-Za-z0-9+/]++=*+(?=[\"',;+\x20\t\r]*+(?:[\\\n]|\Z)))*+"
             rf"(?:{_JUNK}[A-Za-z0-9+/]*+=*+{_JUNK}-----END [A-Z ]*PRIVATE KEY-----)?+")

# The three base kinds, then further kinds of published token formats.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         group=2, min_chars=8, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", min_chars=16),
    Rule("hex", r"[0-9a-f]+", min_chars=32),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _PEM_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_chars=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_chars=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_chars=39),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]+", min_chars=24),
    # begin where a run begins and never give back, so that a scan stays linear
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]++\.eyJ[A-Za-z0-9_-]++\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"(?<![a-z])[a-z]++://[^\s/:@]++:([^\s/:@]++)@", group=1, min_chars=4),
)
RULES = BASE_RULES + MORE_RULES
BASE_KINDS = tuple(r.kind for r in BASE_RULES)

OUT = ("n_assign long, n_access long, n_hex long, n_spans long, base_sha256 string, spans string")

# A Boolean trigram query: ALL (no restriction), ("tri", s), ("and", parts) or ("or", parts).
ALL = ("all",)
# Limits of the literal strings followed through a pattern; beyond them the query gets weaker, never wrong.
MAX_STRINGS = 64
MAX_CHARS = 24


def _both(a, b):
    parts = [q for q in (a, b) if q != ALL]
    return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _any(parts):
    parts = list(dict.fromkeys(parts))
    return ALL if not parts or ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _holds(strings):
    """Query that any text with one of ``strings`` satisfies."""
    options = []
    for s in strings:
        tris = [s[i:i + 3] for i in range(len(s) - 2)]
        query = ALL
        for t in dict.fromkeys(tris):
            query = _both(query, ("tri", t))
        options.append(query)
    return _any(options)


def trigram_query(rule: Rule):
    """Boolean trigram query that every text with a match of the rule satisfies.

    Walks the parsed pattern with the set of literal strings that may end at the
    current place; where the set breaks off, what it implies joins the query.
    """
    def walk(items):
        """(query, heads): ``heads`` are all strings the items can match, or None if not listable."""
        query, ends = ALL, {""}
        complete = True
        for op, arg in items:
            step, more = one(op, arg)
            query = _both(query, step)
            joined = None if more is None else {a + b for a in ends for b in more}
            if joined is None or len(joined) > MAX_STRINGS or any(len(s) > MAX_CHARS for s in joined):
                query = _both(query, _holds(ends))
                if more is not None:
                    query = _both(query, _holds(more))
                ends, complete = {""}, False
            else:
                ends = joined
        if complete:
            return query, ends
        return _both(query, _holds(ends)), None

    def one(op, arg):
        if op is rc.LITERAL:
            c = chr(arg)
            return ALL, {c.lower()} if c.isascii() else None
        if op is rc.IN:
            chars = set()
            for kind, value in arg:
                if kind is not rc.LITERAL or value > 127:
                    return ALL, None
                chars.add(chr(value).lower())
            return ALL, chars
        if op is rc.SUBPATTERN:
            return walk(arg[-1])
        if op is rc.BRANCH:
            found = [walk(branch) for branch in arg[1]]
            if all(strings is not None for _, strings in found):
                return _any([q for q, _ in found]), set().union(*(s for _, s in found))
            return _any([q if s is None else _both(q, _holds(s)) for q, s in found]), None
        if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
            low, high, body = arg
            query, strings = walk(body)
            if low == 0:
                return ALL, ({""} | strings if high == 1 and strings is not None else None)
            if low == 1 and high == 1:
                return query, strings
            return (_both(query, _holds(strings)) if strings is not None else query), None
        if op in (rc.AT, rc.ASSERT, rc.ASSERT_NOT):         # no characters of their own
            return ALL, {""}
        return ALL, None

    query, strings = walk(rp.parse(rule.pattern))
    return query if strings is None else _both(query, _holds(strings))


def _trigrams(query) -> set[str]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*(_trigrams(q) for q in query[1])) if query[0] in ("and", "or") else set()


class Scanner:
    """Rules with their trigram queries; finds the spans of a batch of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.queries = [trigram_query(r) for r in rules]
        named = sorted(set().union(*(_trigrams(q) for q in self.queries)))
        self.number = {t: i for i, t in enumerate(named)}
        self.codes = np.array([(ord(t[0]) << 16) | (ord(t[1]) << 8) | ord(t[2]) for t in named], np.int64)
        self.slot = np.zeros(1 << 24, np.uint16)            # trigram code -> its number + 1
        self.slot[self.codes] = np.arange(1, len(named) + 1)
        self.regexes = [r.regex() for r in rules]
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, raw: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        """Inverted index: for each named trigram the sorted numbers of the texts that hold it."""
        if len(raw) < 3 or not len(self.codes):
            return [np.zeros(0, np.int64)] * len(self.codes)
        low = self.fold[raw].astype(np.uint32)
        found = self.slot[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]]
        at = np.flatnonzero(found)
        text = np.searchsorted(off, at, side="right") - 1
        inside = at + 3 <= off[text + 1]                    # not across two texts
        pairs = np.unique(found[at[inside]].astype(np.int64) * len(off) + text[inside])
        number, text = pairs // len(off) - 1, pairs % len(off)
        cuts = np.searchsorted(number, np.arange(len(self.codes) + 1))
        return [text[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def candidates(self, query, index: list[np.ndarray], n: int) -> np.ndarray:
        if query[0] == "all":
            return np.arange(n)
        if query[0] == "tri":
            return index[self.number[query[1]]]
        found = [self.candidates(q, index, n) for q in query[1]]
        out = found[0]
        for other in found[1:]:
            out = (np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other))
        return out

    def spans(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, kind number, end) spans in code points, sorted."""
        raw, off = text_bytes(column)
        texts = column.to_pylist()
        index = self.postings(raw, off)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, self.regexes)):
            for i in self.candidates(query, index, len(texts)).tolist():
                if texts[i]:
                    out[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i])
                               if m.end(rule.group) - m.start(rule.group) >= rule.min_chars]
        for found in out:
            found.sort()
        return out


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    made = worker_cache("secrets")
    if repr(rules) not in made:
        made[repr(rules)] = Scanner(rules)
    return made[repr(rules)]


def scan(column: pa.Array, rules: tuple[Rule, ...] = RULES) -> dict[str, pa.Array]:
    kinds = [r.kind for r in rules]
    base = {kinds.index(k): k for k in BASE_KINDS if k in kinds}
    counts = {k: [] for k in BASE_KINDS}
    n_spans, digests, joined = [], [], []
    for found in scanner(rules).spans(column):
        show = lambda some: ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in some)     # noqa: E731
        core = [s for s in found if s[1] in base]
        for k in BASE_KINDS:
            counts[k].append(sum(base[s[1]] == k for s in core))
        n_spans.append(len(found))
        digests.append(hashlib.sha256(show(core).encode()).hexdigest())
        joined.append(show(found))
    return {"n_assign": longs(counts["assign"]), "n_access": longs(counts["access"]), "n_hex": longs(counts["hex"]),
            "n_spans": longs(n_spans), "base_sha256": pa.array(digests, pa.string()), "spans": pa.array(joined, pa.string())}


def redact(text: str | None, spans: str, mask: str = "[secret]") -> str | None:
    """``text`` with every span (``kind:start:end`` list, merged where they overlap) replaced."""
    if not text or not spans:
        return text
    out, at = [], 0
    for a, b in sorted(tuple(map(int, s.rsplit(":", 2)[1:])) for s in spans.split(",")):
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join(out) + text[at:]


def secret_scan(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` plus span counts and spans of every text (see the module docstring)."""
    return append_columns(docs, text_col, OUT, lambda column: scan(column, rules), owner="secrets")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES,
                   mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text_col`` replaced by ``mask``; no row is dropped."""
    def masked(column: pa.Array) -> dict[str, pa.Array]:
        spans = scan(column, rules)["spans"].to_pylist()
        return {text_col: pa.array([redact(t, s, mask) for t, s in zip(column.to_pylist(), spans)], pa.string())}

    return append_columns(docs, text_col, f"`{text_col}` string", masked, owner="secrets").select(docs.columns)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secret_scan(docs.select("doc_id", "text")).drop("text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets masked; ``n_chars``, where present, follows the new text."""
    from pyspark.sql import functions as F

    out = redact_secrets(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
