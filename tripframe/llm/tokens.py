"""Token counts of whole texts under a ``tokenizers`` vocabulary file.

``count(docs, path)`` runs the library in Arrow functions that return lengths
only. Batches are cut by bytes, not rows. Texts are split at safe boundaries
(``pretoken``): ordinary texts into units whose counts are cached per task, so
the library encodes each distinct unit once, in joined strings of about
``JOIN`` characters; other texts whole, or in pieces if they are long. Special
strings inside texts are handled as the library does by default; no begin, end
or added special tokens, truncation or padding.

Null texts count as empty (0 bytes, 0 tokens). Repeated rows each get their own
result, null ids are kept, extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tripframe.llm import common as C
from tripframe.llm import pretoken, wordhash

JOIN = 8192
_LOADED: dict[str, "Counter"] = {}


class Counter:
    """Counts under one vocabulary file, kept for the life of a worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # Spark has the cores
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocab.values()) + 1, dtype=bool)
        # A space is spelled U+0120 in byte-level vocabularies.
        self.opens[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self.spaced = pretoken.UnitCache(self._spaced)
        self.lined = pretoken.UnitCache(lambda us: self._each(["\n" + u for u in us]))
        self.plain = pretoken.UnitCache(self._each)

    def _each(self, texts) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _spaced(self, us) -> list[int]:
        """Counts of units that a space opens, from encodings of joined units:
        a token that begins with a space opens a unit."""
        lots: list[list[str]] = [[]]
        size = 0
        for u in us:
            if size >= JOIN:
                lots.append([])
                size = 0
            lots[-1].append(" " + u)
            size += len(u) + 1
        out: list[int] = []
        for lot, e in zip(lots, self.tok.encode_batch_fast(["".join(x) for x in lots],
                                                           add_special_tokens=False)):
            ids = np.array(e.ids, dtype=np.int64)
            first = np.flatnonzero(self.opens[ids])
            if len(first) != len(lot):        # a unit that is empty or has odd white space
                out += self._each(lot)
            else:
                out += np.diff(np.append(first, len(ids))).tolist()
        return out

    def counts(self, texts: list[str]) -> list[int]:
        split = [pretoken.units(t) for t in texts]
        spaced: set[str] = set()
        lined: set[str] = set()
        for s in split:
            if s:
                spaced.update(s[0])
                lined.update(s[1])
        plain = {s[2] for s in split if s}
        a, b, c = self.spaced.learn(spaced), self.lined.learn(lined), self.plain.learn(plain)
        out = []
        for t, s in zip(texts, split):
            if s:
                out.append(sum(map(a.__getitem__, s[0])) + sum(map(b.__getitem__, s[1])) + c[s[2]])
            else:
                out.append(sum(self._each(list(pretoken.pieces(t)))))
        return out


def counter(path: str) -> Counter:
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Counter(path)
    return _LOADED[path]


def count(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in batches:
            _, off = wordhash.text_bytes(b.column(1))
            texts = [t or "" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.diff(off), pa.int64()),
                 pa.array(c.counts(texts), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    return C.keyed_text(docs, key, text).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
