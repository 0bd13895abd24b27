"""Token counts: pieces once per distinct pre-token, joined to each document's frequencies.

Each slice of documents becomes rows of (document, pre-token, frequency); its distinct
pre-tokens are counted in pieces once and joined in by their hash, and the products are
summed by document. No token ids are built for documents. The join stays inside the
task: the table of distinct pre-tokens grows with the corpus, so it is neither broadcast
nor are the far more numerous (document, pre-token) rows shuffled; a worker keeps the
pieces of a bounded number of pre-tokens (half of ``pretoken_spans.SLOTS``) and asks the tokenizer again for
others.

Defined cases: null text counts as empty (0 bytes, 0 tokens); added tokens whose string
stands in a text count as one token, as the library does by default; repeated rows are
counted each; an empty table gives an empty result. Nothing is truncated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import Texts, slices
from foliospark.llm.pretoken_spans import Encodings, encodings, spans
from foliospark.llm.pretokens import pieces

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512


def frequencies(e: Encodings, t: Texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, pieces of a pre-token, frequency) of a slice's texts, without zero rows,
    for one stretch of pre-tokens after the other."""
    start, bound = spans(t)
    for a, z, slot in e.parts(t, start):
        doc = np.searchsorted(bound, np.arange(a, z), side="right") - 1
        key, times = np.unique(doc * len(e.key) + slot, return_counts=True)
        yield key // len(e.key), e.size[key % len(e.key)], times


def counts(e: Encodings, column: pa.Array, path: str) -> np.ndarray:
    """Tokens of each text of a column."""
    n = np.zeros(len(column), np.int64)
    for doc, size, times in frequencies(e, Texts(column)):
        n += np.bincount(doc, times * size, len(column)).astype(np.int64)
    for a in e.added:  # texts that hold an added token's string are cut there
        for i in np.flatnonzero(np.asarray(pa.compute.match_substring(column, a).fill_null(False))):
            n[i] = len(pieces(path).id_bytes(column[int(i)].as_py())) // 4
    return n


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encodings(path)
        for b in slices(batches, "k_body"):
            body = b.column("k_body")
            n = counts(e, body, path)
            size = pa.compute.binary_length(body.cast(pa.binary())).fill_null(0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("k_body"))
    return body.mapInArrow(_count(path or public_tokenizers.path(VOCABULARY), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
