"""Byte-level BPE encoding and decoding by a local rank file.

``encode(docs, path)`` gives every whole text's ids under the rank file, as
``tiktoken`` would: each match of the split pattern is merged separately and
there are no special tokens. The library does all merging. Long texts are cut
into pieces at safe boundaries first (``pretoken``), as the library's regex
engine overflows on very long runs of white space. ``decode`` maps ids back to raw bytes by the
rank file's byte strings, in numpy: bytes, not text, so ids that stop inside a
character decode too.

Ids travel as little-endian unsigned 32-bit integers in one binary value.
Null texts count as empty (no ids, no bytes); null ids decode to null. Repeated
rows each get their own result, null document ids are kept, extra columns are
ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripframe.llm import common as C
from tripframe.llm import pretoken

_LOADED: dict[tuple[str, str], "Coder"] = {}


class Coder:
    """One rank file and split pattern, kept for the life of a worker."""

    def __init__(self, path: str, pattern: str):
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.enc = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks,
                                     special_tokens={})
        # The library's matcher recurses too deep in very long runs of white space; there the
        # pattern is matched here and the library merges each match as a whole.
        self.split = regex.compile(pattern)
        self.whole = tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        parts = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            parts[v] = k
        self.size = np.array([len(p) for p in parts], dtype=np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def _pack(self, text: str) -> bytes:
        if pretoken.is_long_run(text):
            ids = [i for m in self.split.findall(text) for i in self.whole.encode_ordinary(m)]
        else:
            ids = self.enc.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self._pack(p) for p in pretoken.pieces(t)) for t in texts]

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, dtype="<u4").astype(np.int64)
        if not len(i):
            return b""
        n = self.size[i]
        first = np.cumsum(n) - n
        return self.bytes[np.repeat(self.at[i] - first, n) + np.arange(int(n.sum()))].tobytes()


def coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[path, pattern] = Coder(path, pattern)
    return _LOADED[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decoded: bool = False) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of every row; with ``decoded`` also
    the bytes that the ids decode to, from the same task."""
    C.bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            ids = c.encode([t or "" for t in b.column(1).to_pylist()])
            cols = [b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array(ids, pa.binary())]
            names = ["doc_id", "n_tokens", "ids"]
            if decoded:
                cols.append(pa.array([c.decode(x) for x in ids], pa.binary()))
                names.append("decoded")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "doc_id long, n_tokens long, ids binary" + ", decoded binary" * decoded
    return C.keyed_text(docs, key, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids"
           ) -> DataFrame:
    """``doc_id`` and the raw bytes (``decoded``) of every row's ids."""
    C.bound_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path, pattern)
        for b in batches:
            out = [None if x is None else c.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())],
                                             names=["doc_id", "decoded"])

    return encoded.select(C.column(key).cast("long").alias("doc_id"), C.column(ids).alias("ids")
                          ).mapInArrow(run, "doc_id long, decoded binary")


def digest(encoded: DataFrame) -> DataFrame:
    """The contract's columns of ``encode(..., decoded=True)``."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
