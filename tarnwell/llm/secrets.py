"""Secret scans through a trigram index.

Each rule's regular expression is analysed once into a Boolean query over the
three-byte substrings that any match must hold. Every segment of documents gets
an inverted index of just those trigrams; postings are intersected and united
as the query says, and only the documents that remain are searched with the
expression itself. A rule without mandatory trigrams scans all documents.

Edge cases: a null or empty text has no spans; a null id stays null; repeated
rows each give a row; an empty table gives an empty result; extra columns are
ignored by find_secrets() and kept by drop_secrets().
"""

from __future__ import annotations

import re
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lower_table, raw_bytes, slices, table

_ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""

#: (kind, expression, group whose length counts, least length). The first three are the base kinds.
RULES: tuple[tuple[str, str, int, int], ...] = (
    ("assign", _ASSIGN, 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("slack", r"xox[abprs]-[0-9A-Za-z-]{10,}", 0, 15),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 30),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE_KINDS = ("assign", "access", "hex")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"

#: Sets of literal strings grow no larger than this while an expression is analysed.
_MOST_STRINGS = 64


def trigram_query(pattern: str) -> tuple:
    """("all",) or a tree of ("and", ...), ("or", ...) and ("tri", bytes) that every match satisfies, case folded."""
    query, last = _sequence(rp.parse(pattern, re.ASCII))
    return _simple("and", [query, _from_strings(last)])


def _simple(op: str, parts: list[tuple]) -> tuple:
    if op == "or" and (not parts or ("all",) in parts):
        return ("all",)
    parts = list(dict.fromkeys(p for p in parts if p != ("all",)))
    if not parts:
        return ("all",)
    return parts[0] if len(parts) == 1 else (op, *parts)


def _from_strings(strings: frozenset[bytes]) -> tuple:
    return _simple("or", [_simple("and", [("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _strings(node) -> frozenset[bytes] | None:
    """All strings that a node can match, if they are few; folded to lower case."""
    op, arg = node
    if op is rc.LITERAL:
        return frozenset([chr(arg).lower().encode()])
    if op is rc.IN:
        found: set[bytes] = set()
        for kind, x in arg:
            if kind is rc.LITERAL:
                found.add(chr(x).lower().encode())
            elif kind is rc.RANGE and x[1] - x[0] < 8:
                found.update(chr(c).lower().encode() for c in range(x[0], x[1] + 1))
            else:
                return None
        return frozenset(found) if len(found) <= 8 else None
    if op is rc.SUBPATTERN:
        return _product(arg[3])
    if op is rc.BRANCH:
        out: set[bytes] = set()
        for branch in arg[1]:
            got = _product(branch)
            if got is None:
                return None
            out |= got
        return frozenset(out)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[1] <= 4:
        inner = _product(arg[2])
        if inner is None:
            return None
        out, power = set(), frozenset([b""])
        for k in range(arg[1] + 1):
            if k >= arg[0]:
                out |= power
            power = _times(power, inner)
            if power is None:
                return None if k < arg[1] else frozenset(out)
        return frozenset(out)
    return None


def _times(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes] | None:
    return frozenset(x + y for x in a for y in b) if len(a) * len(b) <= _MOST_STRINGS else None


def _product(items) -> frozenset[bytes] | None:
    out = frozenset([b""])
    for node in items:
        got = _strings(node)
        out = None if got is None else _times(out, got)
        if out is None:
            return None
    return out


def _sequence(items) -> tuple[tuple, frozenset[bytes]]:
    """Query so far, and the strings that stand directly before the end."""
    query, before = ("all",), frozenset([b""])
    for node in items:
        got = _strings(node)
        joined = None if got is None else _times(before, got)
        if joined is not None:
            before = joined
            continue
        query = _simple("and", [query, _from_strings(before)])
        before = frozenset([b""]) if got is None else got
        op, arg = node
        inner = arg[3] if op is rc.SUBPATTERN else arg[2] if op in (rc.MAX_REPEAT, rc.MIN_REPEAT) and arg[0] else None
        if got is None and inner is not None:
            sub, rest = _sequence(inner)
            query = _simple("and", [query, sub, _from_strings(rest)])
        elif op is rc.BRANCH and got is None:
            parts = [_sequence(b) for b in arg[1]]
            query = _simple("and", [query, _simple("or", [_simple("and", [q, _from_strings(r)]) for q, r in parts])])
    return query, before


def _trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set().union(*[_trigrams(q) for q in query[1:]])


class SegmentIndex:
    """Postings of the given trigrams over one segment of documents."""

    fold = lower_table()

    def __init__(self, trigrams: list[bytes]):
        self.trigrams = trigrams
        self.codes = np.array([int.from_bytes(t, "big") for t in trigrams], dtype=np.uint32)
        self.known = np.zeros(1 << 24, dtype=bool)
        self.known[self.codes] = True
        self.order = np.argsort(self.codes)
        self.postings: dict[bytes, np.ndarray] = {}
        self.everything = np.arange(0)

    def load(self, texts: list[bytes]) -> None:
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        b = self.fold[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)].astype(np.uint32)
        codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
        at = np.flatnonzero(self.known[codes])
        which = self.order[np.searchsorted(self.codes[self.order], codes[at])]
        pairs = np.unique(which.astype(np.int64) * len(texts) + np.searchsorted(starts, at, "right") - 1)
        self.everything = np.arange(len(texts))
        self.postings = {t: pairs[pairs // len(texts) == k] % len(texts) for k, t in enumerate(self.trigrams)}

    def documents(self, query: tuple) -> np.ndarray:
        if query[0] == "all":
            return self.everything
        if query[0] == "tri":
            return self.postings[query[1]]
        parts = sorted((self.documents(q) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out


def find_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = 2 << 20) -> DataFrame:
    """One row per document: its id and all spans (code points, end exclusive), by start and then by rule."""
    queries = [trigram_query(r[1]) for r in rules]
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        index = SegmentIndex(sorted(set().union(*[_trigrams(q) for q in queries if q != ("all",)])))
        compiled = [(kind, re.compile(p, re.ASCII), re.compile(p.encode(), re.ASCII), group, least) for kind, p, group, least in rules]
        for batch in batches:
            texts = [t or b"" for t in raw_bytes(batch.column(1))]
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for first, last in slices([len(t) for t in texts], segment_bytes):
                part = texts[first:last]
                index.load(part)
                for k, (_, pattern, on_bytes, group, least) in enumerate(compiled):
                    for d in index.documents(queries[k]):
                        if on_bytes.search(part[d]):
                            for m in pattern.finditer(part[d].decode("utf-8", "replace")):
                                if m.end(group) - m.start(group) >= least:
                                    found[first + d].append((m.start(), k, m.end()))
            spans = [[{"kind": rules[k][0], "start": s, "end": e} for s, k, e in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {id_type}, spans {SPANS}")


def drop_secrets(docs: DataFrame, rules=RULES, text_col: str = "text", mark: str = "[secret]", segment_bytes: int = 2 << 20) -> DataFrame:
    """The same documents and columns, with each secret in the text replaced by a mark; clean texts are untouched."""
    queries = [trigram_query(r[1]) for r in rules]
    schema = docs.schema
    place = schema.names.index(text_col)

    def scan(batches):
        index = SegmentIndex(sorted(set().union(*[_trigrams(q) for q in queries if q != ("all",)])))
        compiled = [(re.compile(p, re.ASCII), re.compile(p.encode(), re.ASCII), group, least) for _, p, group, least in rules]
        for batch in batches:
            texts = raw_bytes(batch.column(place))
            out = list(texts)
            for first, last in slices([len(t or b"") for t in texts], segment_bytes):
                part = [t or b"" for t in texts[first:last]]
                index.load(part)
                spans: dict[int, list[tuple[int, int]]] = {}
                for k, (pattern, on_bytes, group, least) in enumerate(compiled):
                    for d in index.documents(queries[k]):
                        if on_bytes.search(part[d]):
                            got = [m.span() for m in pattern.finditer(part[d].decode("utf-8", "replace")) if m.end(group) - m.start(group) >= least]
                            if got:
                                spans.setdefault(int(d), []).extend(got)
                for d, got in spans.items():
                    text, kept, end = part[d].decode("utf-8", "replace"), [], 0
                    for s, e in sorted(got):
                        if s >= end:
                            kept += [text[end:s], mark]
                        end = max(end, e)
                    out[first + d] = ("".join(kept) + text[end:]).encode()
            kind = batch.schema.field(place).type
            fixed = pa.array(out, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).cast(kind)
            yield batch.set_column(place, batch.schema.field(place), fixed)

    return docs.mapInArrow(scan, schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )
