"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text.

* Folding: lower case; look-alike letters of other scripts and full-width
  forms become Latin letters; zero-width characters go; inside a word that has
  letters, digits and signs that stand for letters become them (``1d10t``).
* Lexicon: words and word stems (a stem matches at the start of a word), each
  with a weight: the smoothed log-odds of the label among labelled training
  texts with the entry; the ``MAX_ENTRIES`` entries of most toxic texts stay. An entry needs ``MIN_DOCS`` toxic texts and a lower
  confidence bound of its share above ``MIN_SHARE``; of entries with the same
  texts the longest counts, and entries that a shorter one covers are dropped.
* Exception phrases take precedence: an entry inside an exception phrase of
  the text does not count.
* Score: the sum of matched weights, also per square root of the length in
  words, through a logistic curve fitted to the other half of the training
  texts.

``fit`` reads at most ``rows`` labelled training texts (a documented bound, by
a seeded hash of the id), so the model is small; ``score`` reads every whole
text. Null texts count as empty and score like a text without matches. Labels
that are null are not used; a text labelled twice counts twice. Without any
labelled text every score is 0. Repeated rows each get a result, null ids are
kept, extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C

ROWS = 20_000
MIN_DOCS, MIN_SHARE, MAX_ENTRIES = 8, 0.5, 5_000
STEM = range(3, 9)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ӏ": "l",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l",
}
#: Digits and signs that stand for letters.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
               "@": "a", "$": "s", "!": "i"}
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "idiot proof",
              "scum of the pond", "sore loser", "worthless currency")

_FOLD = {ord(k): v for k, v in HOMOGLYPHS.items()}
_FOLD |= {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_FOLD |= {c: None for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_SUBST = str.maketrans(SUBSTITUTES)
_MIXED = re.compile(r"(?<![\w@$!])(?=[\w@$!]*[^\W\d_])[\w@$!]*[0-9@$!][\w@$!]*")
_SPLIT = re.compile(r"[\W_]+")
_PLAIN = re.compile("[%s]" % re.escape("".join(map(chr, _FOLD))))


def _letters(m: re.Match) -> str:
    """Signs at the end of a word stay signs (``stop!``)."""
    word = m.group()
    body = word.rstrip("!$@")
    return body.translate(_SUBST) + word[len(body):]


def fold(text: str | None) -> str:
    """Folded words, with one space before, between and after them."""
    t = (text or "").lower()
    if _PLAIN.search(t):
        t = t.translate(_FOLD)
    t = _MIXED.sub(_letters, t)
    t = _SPLIT.sub(" ", t).strip()
    return f" {t} " if t else " "


def entries_of(text: str | None) -> set[str]:
    """Possible entries of a text: ``" word "`` and ``" stem"``."""
    out = set()
    for w in set(fold(text).split()):
        if len(w) >= STEM[0]:
            out.add(f" {w} ")
            out.update(" " + w[:k] for k in STEM if k <= len(w))
    return out


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    coef: tuple[float, float, float]           # bias, sum of weights, by length
    exceptions: tuple[str, ...] = EXCEPTIONS


def crc_fold(key: Column) -> Column:
    """crc32 of the id as text, modulo 5."""
    return F.crc32(key.cast("string").cast("binary")) % 5


def choose(counts: Sequence[tuple[str, int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Lexicon from (entry, toxic texts, all texts)."""
    share: dict[str, tuple[float, int, int]] = {}
    for e, t, n in counts:
        p = t / n
        z2 = 1.96 ** 2
        low = (p + z2 / (2 * n) - 1.96 * math.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)
        if t >= MIN_DOCS and low >= MIN_SHARE:
            w = math.log((t + 0.5) / (n - t + 0.5)) - math.log((toxic + 0.5) / (clean + 0.5))
            share[e] = (w, t, n)
    longer = {}
    for e, v in share.items():                 # the longest of entries with the same texts
        for k in range(2, len(e)):
            if share.get(e[:k], (0,))[1:] == v[1:]:
                longer[e[:k]] = True
    kept: dict[str, float] = {}
    for e in sorted((e for e in share if e not in longer), key=lambda e: (len(e), e)):
        if not any(kept.get(e[:k], -1e9) >= share[e][0] - 1 for k in range(2, len(e))):
            kept[e] = share[e][0]
    top = sorted(kept, key=lambda e: (-share[e][1], e))[:MAX_ENTRIES]
    return {e: kept[e] for e in top}


class Matcher:
    def __init__(self, lexicon: dict[str, float], exceptions: Sequence[str]):
        import ahocorasick
        self.auto = ahocorasick.Automaton()
        for e, w in lexicon.items():
            self.auto.add_word(e, (len(e), w))
        for e in exceptions:
            f = fold(e)
            self.auto.add_word(f, (len(f), None))
        self.some = len(self.auto) > 0
        if self.some:
            self.auto.make_automaton()

    def features(self, text: str | None) -> tuple[float, float]:
        """(log of 1 + sum of weights, sum of weights by square root of words)."""
        if not self.some:
            return 0.0, 0.0
        t = fold(text)
        hits = [(end - n + 1, end + 1, w) for end, (n, w) in self.auto.iter(t)]
        if not hits:
            return 0.0, 0.0
        starts, reach = [], []                 # exceptions by start, and how far they reach so far
        for s, e in sorted((s, e) for s, e, w in hits if w is None):
            starts.append(s)
            reach.append(max(e, reach[-1]) if reach else e)

        def harmless(s: int, e: int) -> bool:
            i = bisect_right(starts, s)
            return i > 0 and reach[i - 1] >= e

        best: dict[int, float] = {}            # one entry per word: the heaviest
        for s, e, w in hits:
            if w is not None and not harmless(s, e):
                best[s] = max(w, best.get(s, w))
        total = sum(best.values())
        return math.log1p(max(0.0, total)), total / math.sqrt(max(1, t.count(" ") - 1))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic regression by Newton steps (three coefficients)."""
    b = np.zeros(x.shape[1])
    pen = ridge * np.eye(x.shape[1])
    pen[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve(x.T * (p * (1 - p)) @ x + pen, x.T @ (y - p) - pen @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def fit(docs: DataFrame, labels: DataFrame, rows: int = ROWS, key: str = "doc_id",
        text: str = "text", label: str = "toxic", train: Column | None = None) -> Model:
    """Model from the labelled texts whose ``crc_fold`` is not 0 (or ``train``,
    a condition on ``doc_id``). At most ``rows`` labelled rows are used."""
    spark = docs.sparkSession
    C.bound_batches(spark)
    train = crc_fold(F.col("doc_id")) != 0 if train is None else train
    # Bounded by ``rows``, so fit to be broadcast.
    sample = (labels.select(C.column(key).cast("long").alias("doc_id"),
                            (C.column(label) > 0).cast("int").alias("y"))
              .filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & train)
              .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "y").limit(rows))
    texts = C.keyed_text(docs, key, text).join(F.broadcast(sample), "doc_id")
    texts = C.stage(texts.select("doc_id", "text", "y", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2))
                                 .cast("int").alias("half")), "toxic-train")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: Counter = Counter()
            t: Counter = Counter()
            for s, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                e = entries_of(s)
                n.update(e)
                if y:
                    t.update(e)
            # An entry that only clean texts have can't enter the lexicon, but
            # its clean texts matter where another batch has toxic ones.
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array([t[e] for e in n], pa.int64()),
                 pa.array(list(n.values()), pa.int64())], names=["entry", "t", "n"])

    half = texts.filter("half = 0")
    totals = half.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    toxic, clean = int(totals[0]), int(totals[1]) - int(totals[0])
    counts = (half.select("text", "y").mapInArrow(tally, "entry string, t long, n long")
              .groupBy("entry").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
              .filter((F.col("t") >= MIN_DOCS) & (F.col("t") >= MIN_SHARE * F.col("n"))))
    lexicon = choose([tuple(r) for r in counts.collect()], toxic, clean)   # at most rows * words of a bounded sample
    model = Model(lexicon, (0.0, 0.0, 0.0))
    other = features(texts.filter("half = 1"), model, ["y"]).select("y", "a", "b").toPandas()
    if not len(other) or not lexicon:
        return Model(lexicon, (-30.0, 0.0, 0.0))
    x = np.column_stack([np.ones(len(other)), other["a"], other["b"]])
    return Model(lexicon, tuple(float(c) for c in _logistic(x, other["y"].to_numpy(float))))


def features(docs: DataFrame, model: Model, keep: Sequence[str] = ()) -> DataFrame:
    """(``doc_id``, kept int columns, ``a``, ``b``) of rows with ``doc_id``, ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(model.lexicon, model.exceptions)
        for b in batches:
            f = [m.features(t) for t in b.column(1).to_pylist()]
            cols = [b.column(0), *[b.column(2 + i) for i in range(len(keep))],
                    pa.array([x for x, _ in f], pa.float64()), pa.array([x for _, x in f], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *keep, "a", "b"])

    schema = "doc_id long, " + "".join(f"{k} int, " for k in keep) + "a double, b double"
    return docs.select("doc_id", "text", *keep).mapInArrow(run, schema)


def scored(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with its own columns and the score of each whole text."""
    C.bound_batches(docs.sparkSession)

    @F.arrow_udf("struct<a double, b double>")
    def both(texts: pa.Array) -> pa.Array:
        m = Matcher(model.lexicon, model.exceptions)
        f = [m.features(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([x for x, _ in f], pa.float64()),
                                           pa.array([x for _, x in f], pa.float64())], names=["a", "b"])

    c0, c1, c2 = model.coef
    own = "_tox"
    while own in docs.columns:
        own += "_"
    out = docs.withColumn(own, both(C.column(text).cast("string")))
    z = F.lit(c0) + F.lit(c1) * F.col(f"{own}.a") + F.lit(c2) * F.col(f"{own}.b")
    return out.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).drop(own)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``score`` in [0, 1], ``predicted``."""
    C.bound_batches(docs.sparkSession)
    c0, c1, c2 = model.coef
    z = F.lit(c0) + F.lit(c1) * F.col("a") + F.lit(c2) * F.col("b")
    out = features(C.keyed_text(docs, key, text), model)
    out = out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))
    return out.select("doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
