"""Operator 5: secret scans with a trigram inverted index.

Each rule's regex is turned into a Boolean query over byte trigrams that any match must contain: literal runs give
ANDs, alternatives and small character classes ORs. Trigrams are of lower-cased ASCII, so that rules may ignore case.
Documents are indexed in segments: a batch's bytes give, for every
trigram that a query names, the sorted list of the documents that hold it (its postings). A rule's query is answered by
intersecting and uniting postings, and only the documents it leaves are run through the regex. Rules whose regex
implies no trigram scan every document. Indexes are local to their segment, so nothing is shuffled.
"""

from __future__ import annotations

import re
import re._parser as _parse
from collections import Counter
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import prepare

#: Patterns that Python and RE2 read alike. Runs that may fail at their end are bounded, or begin at a literal that the index knows.
RULES: dict[str, str] = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "stripe_key": r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}\b",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{8,}\.eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]+",
    "password_assignment": r"(?i)\b(?:password|passwd|pwd)\s*[:=]\s*[\"']?[^\s\"']{6,}",
    "secret_assignment": r"(?i)\b(?:token|secret|api_?key)\s*[:=]\s*[\"'][^\s\"']{12,}[\"']",
    "url_credentials": r"\b[a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:[^\s:/@]+@[^\s/]+",
    "hex_digest": r"\b(?:[0-9a-f]{64}|[0-9a-f]{40})\b",
}

#: A query is True (says nothing), a trigram, ("and", parts) or ("or", parts).
Query = bool | bytes | tuple
_MOST = 64  # strings that a set of literals may grow to
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _both(a: Query, b: Query) -> Query:
    if a is True or a == b:
        return b
    return a if b is True else ("and", (a, b))


def _either(parts: list[Query]) -> Query:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _needs(strings: set[bytes]) -> Query:
    """What a text must contain if it contains one of the strings."""
    found = []
    for s in sorted(strings):
        q: Query = True
        for k in range(len(s) - 2):
            q = _both(q, s[k : k + 3])
        found.append(q)
    return _either(found) if found else True


def _letter(code: int, ignore: bool) -> bytes | None:
    """A character as the index has it, ASCII in lower case. None: other letters whose case is ignored."""
    return None if ignore and code > 127 else chr(code).encode().lower()


def _class(items: list, ignore: bool) -> set[bytes] | None:
    """The characters of a small class; None if it is large or negated."""
    codes: set[int] = set()
    for op, arg in items:
        if op is _parse.LITERAL:
            codes.add(arg)
        elif op is _parse.RANGE and arg[1] - arg[0] < 8:
            codes |= set(range(arg[0], arg[1] + 1))
        else:
            return None
    out = {_letter(c, ignore) for c in codes}
    return out if None not in out and len(out) <= 10 else None


class _Builder:
    """Walks a parsed regex, carrying the set of strings that the text up to here must end in."""

    def __init__(self, ignore: bool):
        self.ignore = ignore

    def sequence(self, nodes) -> tuple[set[bytes] | None, Query]:
        """(all strings that match, if few; what any match must contain)."""
        run: set[bytes] = {b""}
        whole, query = True, True

        def close() -> None:
            nonlocal run, query, whole
            query = _both(query, _needs(run))
            run, whole = {b""}, False

        for op, arg in nodes:
            strings, inner = self.node(op, arg)
            query = _both(query, inner)
            if strings is None:
                close()
            elif len(run) * len(strings) <= _MOST:
                run = {a + b for a in run for b in strings}
            else:
                close()
                run = strings
        return (run if whole else None), _both(query, _needs(run))

    def node(self, op, arg) -> tuple[set[bytes] | None, Query]:
        if op is _parse.LITERAL:
            own = _letter(arg, self.ignore)
            return (None if own is None else {own}), True
        if op is _parse.IN:
            return _class(arg, self.ignore), True
        if op is _parse.AT:
            return {b""}, True
        if op is _parse.SUBPATTERN:
            strings, query = _Builder(self.ignore or bool(arg[1] & re.IGNORECASE)).sequence(arg[3])
            return (strings, True) if strings is not None else (None, query)
        if op is _parse.BRANCH:
            parts = [self.sequence(p) for p in arg[1]]
            if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= _MOST:
                return set().union(*(s for s, _ in parts)), True
            return None, _either([q for _, q in parts])
        if op in (_parse.MAX_REPEAT, _parse.MIN_REPEAT, _parse.POSSESSIVE_REPEAT):
            low, high, inner = arg
            strings, query = self.sequence(inner)
            if (low, high) == (0, 1) and strings is not None and len(strings) < _MOST:
                return strings | {b""}, True
            if low == high and low <= 4 and strings is not None and len(strings) ** low <= _MOST:
                out = {b""}
                for _ in range(low):
                    out = {a + b for a in out for b in strings}
                return out, True
            return None, (query if low else True)
        return None, True


def trigram_query(pattern: str) -> Query:
    """What byte trigrams any text with a match must contain; True if none can be told."""
    parsed = _parse.parse(pattern)
    return _Builder(bool(parsed.state.flags & re.IGNORECASE)).sequence(parsed)[1]


def _trigrams(query: Query) -> set[bytes]:
    if query is True:
        return set()
    if isinstance(query, bytes):
        return {query}
    return set().union(*(_trigrams(q) for q in query[1]))


class Index:
    """The postings of one segment, for the trigrams that the queries name."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, numbers: dict[bytes, int], table: np.ndarray):
        self.docs, self.numbers = len(offsets) - 1, numbers
        postings = [np.zeros(0, np.int64)] * len(wanted)
        raw = _LOWER[raw]
        if len(raw) >= 3 and len(wanted):
            code = (raw[:-2].astype(np.uint32) << 16) | (raw[1:-1].astype(np.uint32) << 8) | raw[2:]
            at = np.flatnonzero(table[code])
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = at + 3 <= offsets[doc + 1]
            key = np.unique(np.searchsorted(wanted, code[at[inside]]) * np.int64(self.docs) + doc[inside])
            trigram = key // self.docs
            for number, begin in zip(*K.runs(trigram)):
                end = np.searchsorted(trigram, number, side="right")
                postings[number] = key[begin:end] % self.docs
        self.postings = postings

    def answer(self, query: Query) -> np.ndarray:
        """The documents that a query leaves, sorted."""
        if query is True:
            return np.arange(self.docs)
        if isinstance(query, bytes):
            return self.postings[self.numbers[query]]
        parts = [self.answer(q) for q in query[1]]
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


class Scanner:
    """Rules with their queries; scan() indexes a segment and verifies its candidates."""

    def __init__(self, rules: Mapping[str, str]):
        self.rules = {name: re.compile(p) for name, p in rules.items()}
        self.queries = {name: trigram_query(p) for name, p in rules.items()}
        grams = sorted(set().union(*(_trigrams(q) for q in self.queries.values()), set()))
        self.numbers = {g: k for k, g in enumerate(grams)}
        self.wanted = np.array([int.from_bytes(g, "big") for g in grams], np.uint32)

    def scan(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, str, int]]:
        """(document, rule, match, times) of a segment."""
        if not hasattr(self, "table"):
            self.table = np.zeros(1 << 24, bool)
            self.table[self.wanted] = True
        index = Index(raw, offsets, self.wanted, self.numbers, self.table)
        texts: dict[int, str] = {}
        for name, rx in self.rules.items():
            for d in index.answer(self.queries[name]):
                if d not in texts:
                    texts[d] = raw[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace")
                found = Counter(m[0] for m in rx.finditer(texts[d]))
                for match, n in found.items():
                    yield int(d), name, match, n

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def secret_scan(docs: DataFrame, rules: Mapping[str, str] | None = None) -> DataFrame:
    """(doc_id, rule, preview, secret_sha256, n): each different secret that a rule finds in each row of docs.

    The secret itself is not returned: preview is its first 4 characters and its length, and the digest names it.
    Uses doc_id and text alone. Defined cases: a null or empty text holds no secret; a text that several rules match
    gives a row for each; null doc_ids and repeated rows are scanned as they come; an empty table gives no rows;
    texts are scanned whole, at any length. Patterns are in Python's syntax; \\b, \\s and \\d are ASCII.
    """
    prepare(docs.sparkSession)
    scanner = Scanner({k: f"(?a){p}" for k, p in (rules or RULES).items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = K.text_buffer(batch.column("text"))
            for i, j in K.slices(off):
                rows = [(i + d, *rest) for d, *rest in scanner.scan(raw[off[i] : off[j]], off[i : j + 1] - off[i])]
                if rows:
                    at, rule, match, n = zip(*rows)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(rule), pa.array(match), pa.array(n, pa.int64())], ["doc_id", "rule", "secret", "n"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = plain.mapInArrow(run, "doc_id long, rule string, secret string, n long")
    preview = F.concat(F.substring("secret", 1, 4), F.lit("*"), F.length("secret").cast("string"))
    return found.select("doc_id", "rule", preview.alias("preview"), F.sha2("secret", 256).alias("secret_sha256"), "n")


def _sql() -> str:
    one = " UNION ALL ".join("SELECT doc_id, '{}' AS rule, unnest(regexp_extract_all(text, '{}')) AS secret FROM documents".format(k, p.replace("'", "''")) for k, p in RULES.items())
    return f"SELECT doc_id, rule, secret[:4] || '*' || length(secret) AS preview, sha256(secret) AS secret_sha256, n FROM (SELECT doc_id, rule, secret, count(*) AS n FROM ({one}) GROUP BY ALL)"


ORACLE = _sql()
