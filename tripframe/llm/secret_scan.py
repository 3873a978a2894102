"""Secret scans: fixed patterns plus sliding-window entropy.

``scan(docs)`` finds spans of likely credentials in whole texts.

* Base patterns (leftmost, non-overlapping per kind; matches that are too
  short are dropped after matching): ``assign`` (a credential name, ``:`` or
  ``=``, a value of 12 or more characters), ``access`` (an access key id of
  18 or more), ``hex`` (16 or more lower-case hexadecimal digits).
* ``entropy``: candidate strings are maximal runs of ``[A-Za-z0-9+/_=-]`` of
  at least ``WINDOW`` characters. A window of ``WINDOW`` characters slides
  over each candidate; the counts of its characters are updated by one
  character in and one out, and with them the sum of ``c * log2(c)``, so a
  step costs constant time. Each window has a character class (hex, upper
  and digits, base64) with its own threshold in bits, and windows whose
  entropy reaches it are joined into spans. A window of plain letters of one
  case holds no secret for this scan, however varied its letters are.
* Allow-list: candidates that an allow rule matches give no entropy span (a
  UUID, a path or URL, a word list joined by ``-``, ``_`` or ``/``, a run that
  counts up such as ``0123456789abcdef``). Where an entropy span meets base
  spans, its parts outside them remain. Base spans are never suppressed.

Null texts count as empty and give no span. Repeated rows each get their own
result, null ids are kept, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C

#: Fixed values of the base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A maximal run of the class is what the open pattern matches, so asking for
# the least length in the pattern drops just the matches that are too short.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "entropy")
MIN_ASSIGN = 12

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
#: Bits per character that a window of 20 must reach, per character class.
THRESHOLD = {"hex": 3.1, "upper": 3.5, "base64": 3.85}
ALLOW = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"[-_=+/]*([A-Za-z]+[-_=+/]+)*[A-Za-z]*"),      # joined words
    re.compile(r"/?([a-z0-9_.-]{1,15}/)+[a-z0-9_.-]{0,15}"),   # paths
    re.compile(r"[0-9_=+/-]+"),                                # numbers, rules
)
_LOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]


def _class(lower: int, upper: int, digit: int, hexa: int) -> str | None:
    """Character class of a window from the counts of its characters."""
    if hexa == WINDOW and digit:
        return "hex"
    if lower == 0 and upper and digit:
        return "upper"
    if digit and (lower or upper):
        return "base64"
    return None


def _kinds(ch: str) -> tuple[int, int, int, int]:
    return (int("a" <= ch <= "z"), int("A" <= ch <= "Z"), int("0" <= ch <= "9"),
            int(ch in "0123456789abcdefABCDEF"))


def entropy_spans(run: str) -> list[tuple[int, int]]:
    """Spans of ``run`` covered by windows of high entropy."""
    out: list[tuple[int, int]] = []
    count: dict[str, int] = {}
    total = 0.0
    tally = [0, 0, 0, 0]
    steps = 0                       # neighbours that count up or down by one
    for i, ch in enumerate(run):
        c = count.get(ch, 0)
        total += _LOG[c + 1] - _LOG[c]
        count[ch] = c + 1
        for k, v in enumerate(_kinds(ch)):
            tally[k] += v
        if i and abs(ord(ch) - ord(run[i - 1])) == 1:
            steps += 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = count[old]
            total += _LOG[c - 1] - _LOG[c]
            count[old] = c - 1
            for k, v in enumerate(_kinds(old)):
                tally[k] -= v
            if abs(ord(run[i - WINDOW + 1]) - ord(old)) == 1:
                steps -= 1
        if i < WINDOW - 1 or steps > WINDOW // 2:
            continue
        kind = _class(*tally)
        if kind and math.log2(WINDOW) - total / WINDOW >= THRESHOLD[kind] - 1e-9:
            start = i - WINDOW + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def _joined(spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What spans cover, as apart intervals in order."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((s, e) for _, s, e in spans):
        if out and x <= out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` of a text in code points, by start,
    then kind as listed in ``KINDS``."""
    if not text:
        return []
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text)
            if m.end(2) - m.start(2) >= MIN_ASSIGN]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    more = []
    taken = _joined(base)
    at = 0                          # both lists are in order: one sweep over each
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if any(a.fullmatch(run) for a in ALLOW):
            continue
        for s, e in entropy_spans(run):
            s, e = s + m.start(), e + m.start()
            while at < len(taken) and taken[at][1] <= s:
                at += 1
            i = at
            while i < len(taken) and taken[i][0] < e:      # parts outside base spans
                x, y = taken[i]
                if s < x:
                    more.append(("entropy", s, x))
                s = max(s, y)
                i += 1
            if s < e:
                more.append(("entropy", s, e))
    return sorted(base + more, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def spell(spans) -> str:
    """``kind:start:end`` joined by commas."""
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def mask(text: str | None, spans) -> str | None:
    """The text with every span replaced by ``[kind]``; overlapping spans
    become one, named by the first."""
    if not spans:
        return text
    out, at = [], 0
    joined: list[list] = []
    for k, s, e in spans:
        if joined and s < joined[-1][2]:
            joined[-1][2] = max(joined[-1][2], e)
        else:
            joined.append([k, s, e])
    for k, s, e in joined:
        out += [text[at:s], f"[{k}]"]
        at = e
    return "".join(out) + text[at:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``spans array<struct<kind, start,
    end>>`` over the whole text, ``masked`` (the text without its secrets)."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            found = [find(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0),
                 pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in f] for f in found],
                          pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()),
                                              ("end", pa.int64())]))),
                 pa.array([mask(t, f) for t, f in zip(texts, found)], pa.string())],
                names=["doc_id", "spans", "masked"])

    return C.keyed_text(docs, key, text).mapInArrow(
        run, "doc_id long, spans array<struct<kind string, start long, end long>>, masked string")


def masked(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its own columns and every secret in ``text`` masked."""
    C.bound_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array([mask(t, find(t)) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, clean(C.column(text).cast("string")))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's spans."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select("doc_id", number("assign").alias("n_assign"),
                        number("access").alias("n_access"), number("hex").alias("n_hex"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))


def digest_of(text: str | None) -> dict:
    """The contract's columns of one text, by plain Python (for tests)."""
    spans = find(text)
    base = [s for s in spans if s[0] != "entropy"]
    return {"n_assign": sum(s[0] == "assign" for s in base),
            "n_access": sum(s[0] == "access" for s in base),
            "n_hex": sum(s[0] == "hex" for s in base),
            "base_sha256": hashlib.sha256(spell(base).encode()).hexdigest(), "spans": spell(spans)}
