"""Operator 1, secret scans.

Base patterns find assigned passwords, access keys and long hex strings. The method adds
spans: over candidate strings it slides a window whose Shannon entropy is kept up to date
by incremental counts (one character in, one out, so a step costs O(1)), with a threshold
for each character class (hexadecimal strings also need three digits). An allow-list suppresses known harmless strings
among them: whole candidates, segments of paths, and hot ranges.

Results for odd input: a null or empty text has no spans; repeated rows give equal rows; a null
doc_id stays null; other columns are ignored. Texts of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


@dataclass(frozen=True)
class EntropyRules:
    """Window length and least entropy in bits a character, for each character class, and what to let pass."""

    window: int = 20
    least_hex: float = 3.2
    least_base64: float = 3.9
    least_digits: int = 3
    allow: tuple[str, ...] = (
        r"[0-9]+",
        r"[A-Za-z]+",
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"(?i).*(example|sample|dummy|placeholder|changeme|xxxx).*",
        r"(/[A-Za-z_-]+[A-Za-z0-9_-]*)+/?",
        r"[A-Za-z]+([-_/=][A-Za-z]+)*[-_/=]?[0-9]{0,4}",
    )
    compiled: tuple = field(init=False, default=())

    def __post_init__(self):
        object.__setattr__(self, "compiled", tuple(re.compile(x) for x in self.allow))

    def allowed(self, string: str) -> bool:
        return any(x.fullmatch(string) for x in self.compiled)


def hot_windows(string: str, window: int, least: float) -> list[tuple[int, int]]:
    """Merged ranges of the windows whose entropy reaches ``least``.

    With counts c of n characters, entropy is log2(n) - sum(c log2 c) / n; the sum changes in two
    terms when the window moves by one.
    """
    n = min(window, len(string))
    if not n:
        return []
    term = [0.0] + [c * math.log2(c) for c in range(1, n + 1)]
    counts: dict[str, int] = {}
    total, found, whole = 0.0, [], math.log2(n)
    for i, new in enumerate(string):
        c = counts.get(new, 0)
        counts[new] = c + 1
        total += term[c + 1] - term[c] if c < n else 0.0
        if i >= n:
            old = string[i - n]
            c = counts[old]
            counts[old] = c - 1
            total += term[c - 1] - (term[c] if c <= n else term[n])
        if i >= n - 1 and whole - total / n >= least - 1e-9:
            a = i - n + 1
            if found and a <= found[-1][1]:
                found[-1] = (found[-1][0], i + 1)
            else:
                found.append((a, i + 1))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the three base kinds, in code points."""
    spans = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def not_allowed(string: str, rules: EntropyRules) -> list[tuple[int, str]]:
    """Start and text of what remains of a candidate: all of it, or of an allowed one the runs of path segments that aren't allowed."""
    if not rules.allowed(string):
        return [(0, string)]
    runs, at, begin = [], 0, None
    for segment in [*string.split("/"), ""]:  # the last one ends a run
        if segment and not rules.allowed(segment):
            begin = at if begin is None else begin
        elif begin is not None:
            runs.append((begin, string[begin : at - 1]))
            begin = None
        at += len(segment) + 1
    return [(a, s) for a, s in runs if len(s) >= rules.window]


def entropy_spans(text: str, base: list[tuple[int, int, int]], rules: EntropyRules) -> list[tuple[int, int, int]]:
    """High-entropy parts of candidate strings that touch no base span and aren't allowed."""
    spans = []
    for m in CANDIDATE.finditer(text):
        for at, s in not_allowed(m[0], rules):
            hexadecimal = not s.lower().strip("0123456789abcdef")
            for a, b in hot_windows(s, rules.window, rules.least_hex if hexadecimal else rules.least_base64):
                part = s[a:b]
                if hexadecimal and sum(map(str.isdigit, part)) < rules.least_digits or rules.allowed(part):
                    continue
                spans.append((m.start() + at + a, 3 if hexadecimal else 4, m.start() + at + b))
    return [x for x in spans if not any(x[0] < e and s < x[2] for s, _, e in base)] if base else spans


def scan_text(text: str | None, rules: EntropyRules = EntropyRules()) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, then all spans."""
    base = base_spans(text or "")
    return base, sorted(base + entropy_spans(text or "", base, rules))


def show(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SPAN_SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def scan(docs: DataFrame, rules: EntropyRules = EntropyRules()) -> DataFrame:
    """One row a document: counts by kind, the digest of its base spans and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for text in batch.column("text"):
                base, spans = scan_text(text.as_py(), rules)
                kinds = [k for _, k, _ in spans]
                row = (kinds.count(0), kinds.count(1), kinds.count(2), len(spans) - len(base), hashlib.sha256(show(base).encode()).hexdigest(), show(spans))
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], names=SPAN_SCHEMA.replace(" long", "").replace(" string", "").split(", "))

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SPAN_SCHEMA)


def redact(docs: DataFrame, rules: EntropyRules = EntropyRules(), mask: str = "[SECRET]") -> DataFrame:
    """docs with every span of ``text`` replaced by ``mask``; overlapping spans become one."""
    from pyspark.sql import functions as F

    @F.udf("string", useArrow=True)
    def masked(text):
        if text is None:
            return None
        out, at = [], 0
        for s, _, e in scan_text(text, rules)[1]:
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]])

    return docs.withColumn("text", masked("text"))
