"""Secret scans over a trigram inverted index.

Every rule is a regular expression. From its parse tree a Boolean query over mandatory
trigrams is derived (an OR of ANDs over the lower-cased text). Each task indexes its segment
of documents: for the trigrams of the rules it makes postings (sorted positions of the
documents that hold them), intersects and unites the postings, and verifies only candidates
with the expression. A rule without mandatory trigrams scans every document. The index is
split by document, so nothing is shuffled and a hot trigram costs only its own segment.

Edge cases: a null text is empty; repeated rows are scanned as often as they come; offsets
are code points; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from re import _constants as C
from re import _parser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import lean, let_go, small_batches, table

# A private key: its header and all up to the matching footer, before which no other dashes stand.
# Where that is missing, the base64 that follows: a run on the header's line, then header fields,
# empty lines and lines of base64 alone. Line ends may be written as escapes, as in JSON.
PEM = (
    r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----"
    r"(?:[^-]*(?:-(?!----)[^-]*)*-----END \1PRIVATE KEY-----"
    r"|(?:[ \t]*[A-Za-z0-9+/]{40,}={0,2})?"
    r"(?:(?:[ \t]*(?:\r?\n|(?:\\r)?\\n))+[ \t]*(?:(?:Proc-Type|DEK-Info):[^\n\\]*|[A-Za-z0-9+/]+={0,2}(?=[ \t]*(?:\r?\n|\\[rn]|[\"',]|\Z))))*)"
)
# Base rules (kind, pattern, group whose length is tested, least length) first.
RULES = [
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
    ("pem", PEM, 0, 0),
    ("forge", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    ("live", r"[rs]k_live_[A-Za-z0-9]+", 0, 20),
]
BASE = ("assign", "access", "hex")
MAX_SET = 64  # strings that one exact set may hold before the query falls back to what it has


def _joined(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= MAX_SET else None


def _walk(tree) -> list[set[str] | None]:
    """The sequence as exact sets of strings, None where anything may stand."""
    out: list[set[str] | None] = []
    for op, arg in tree:
        if op is C.LITERAL:
            out.append({chr(arg)})
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            out.append({chr(v) for _, v in arg})
        elif op is C.SUBPATTERN:
            out += _walk(arg[-1])
        elif op is C.BRANCH:
            ways = [_merge(_walk(x)) for x in arg[1]]
            whole = all(len(w) == 1 and w[0] is not None for w in ways)
            out.append(set().union(*(w[0] for w in ways)) if whole else None)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, body = arg
            inner = _merge(_walk(body))
            exact = inner[0] if len(inner) == 1 else None
            if exact is not None and low == high and low <= 8:
                out += [exact] * low
            elif exact is not None and (low, high) == (0, 1):
                out.append(exact | {""})
            else:
                out += [*inner * (low > 0), None]
        else:
            out.append(None)
    return out


def _merge(parts: list[set[str] | None]) -> list[set[str] | None]:
    merged: list[set[str] | None] = []
    for p in parts:
        if p is not None and merged and merged[-1] is not None and (both := _joined(merged[-1], p)) is not None:
            merged[-1] = both
        elif p is not None or not merged or merged[-1] is not None:
            merged.append(p)
    return merged or [{""}]


def trigram_query(pattern: str) -> list[list[str]]:
    """An AND of clauses, each an OR of strings (lower case) whose trigrams must all occur;
    empty: the pattern has no mandatory trigram."""
    query = []
    for part in _merge(_walk(_parser.parse(pattern))):
        if part and min(map(len, part)) >= 3:
            query.append(sorted({s.lower() for s in part}))
    return query


def grams(s: str) -> list[bytes]:
    b = s.encode()
    return [b[i : i + 3] for i in range(len(b) - 2)]


class Segment:
    """Postings of a segment's documents for a fixed vocabulary of trigrams."""

    def __init__(self, texts: list[bytes], vocabulary: list[bytes]):
        low = b"\x00\x00".join(t.lower() for t in texts) + b"\x00\x00"
        sizes = np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts))
        a = np.frombuffer(low, np.uint8)
        codes = a[:-2].astype(np.int32) << 16
        codes |= a[1:-1].astype(np.int32) << 8
        codes |= a[2:]
        wanted = np.array(sorted({int.from_bytes(g, "big") for g in vocabulary}), np.int32)
        lut = np.zeros(1 << 24, bool)
        lut[wanted] = True
        at = np.flatnonzero(lut[codes])
        doc = np.searchsorted(np.cumsum(sizes), at, "right")
        self.n, self.postings = len(texts), {}
        found = codes[at]
        order = np.argsort(found, kind="stable")
        found, doc = found[order], doc[order]
        for c, own in zip(wanted.tolist(), np.split(doc, np.searchsorted(found, wanted[1:])), strict=True):
            self.postings[c] = np.unique(own)

    def candidates(self, query: list[list[str]]) -> np.ndarray:
        keep = np.arange(self.n)
        for clause in query:
            some = [self._all(s) for s in clause]
            keep = np.intersect1d(keep, np.unique(np.concatenate(some)), assume_unique=True)
        return keep

    def _all(self, s: str) -> np.ndarray:
        own = None
        for g in sorted((self.postings[int.from_bytes(g, "big")] for g in grams(s)), key=len):
            own = g if own is None else np.intersect1d(own, g, assume_unique=True)
        return own


def scan_segment(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """Per text: (start, rule number, end) of every verified match, in order."""
    queries = [trigram_query(p) for _, p, _, _ in rules]
    vocabulary = [g for q in queries for clause in q for s in clause for g in grams(s)]
    segment = Segment([t.encode("utf-8", "surrogatepass") for t in texts], vocabulary)
    found: list[list] = [[] for _ in texts]
    for k, ((_, pattern, group, least), query) in enumerate(zip(rules, queries, strict=True)):
        regex = re.compile(pattern)
        for i in segment.candidates(query).tolist() if query else range(len(texts)):
            found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i]) if len(m[group]) >= least]
    return [sorted(f) for f in found]


def segments(texts: list[str], chars: int = 2_000_000):
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < chars):
            size += len(texts[stop])
            stop += 1
        yield at, texts[at:stop]
        at = stop


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """(id, found array<struct<kind, start, end>>) by start, then kind as listed."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [r[0] for r in rules]

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b["_text"]]
            for at, part in segments(texts):
                found = [[{"kind": names[k], "start": s, "end": e} for s, k, e in f] for f in scan_segment(part, rules)]
                yield pd.DataFrame({"_id": b["_id"].iloc[at : at + len(part)].to_numpy(), "found": found})

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shape = f"_id {kind}, found array<struct<kind string, start long, end long>>"
    return rows.mapInPandas(run, shape).withColumnRenamed("_id", id_col)


def mask_secrets(docs: DataFrame, text_col: str = "text", rules=RULES, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every found span, overlapping ones together, replaced by ``mask``; null texts stay null."""

    small_batches(docs.sparkSession)
    at_text = docs.columns.index(text_col)

    def run(batches):
        let_go()
        for b in batches:
            clean = b.column(at_text).to_pylist()
            texts = [t or "" for t in clean]
            for at, part in segments(texts):
                for i, spans in enumerate(scan_segment(part, rules), at):
                    if spans:
                        out, end = [], 0
                        for s, _, e in spans:
                            if s >= end:
                                out += [texts[i][end:s], mask]
                            end = max(end, e)
                        clean[i] = "".join([*out, texts[i][end:]])
            yield b.set_column(at_text, b.schema.field(at_text), pa.array(clean, b.schema.field(at_text).type))

    return docs.mapInArrow(lean(run), docs.schema)


def op8_secrets(spark, sf_dir):
    found = find_secrets(table(spark, sf_dir, "documents"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *map(count, BASE), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"))
