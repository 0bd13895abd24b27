"""BPE encoding and decoding by dynamic programming over the prefixes of each pre-token.

A row of token ids is what byte-pair merging gives exactly when every two neighbours
are compatible, that is when merging their joined bytes gives these two tokens back.
So every prefix of a pre-token has one possible last token. An automaton over the
vocabulary, whose state is the longest suffix of what was read that begins a token,
lists the tokens that end at each place; the one that is compatible with the last token
of the prefix before it is stored, and the back-pointers are followed from the end. The
cost is linear in the length, also for one pre-token of megabytes.

Texts are cut into pre-tokens and each distinct one is encoded once per worker, in a
table of bounded size (``pretoken_spans``). Decoding joins the tokens' bytes.

Defined cases: a null text is an empty one (no ids, decoded to the empty text); added
tokens whose string stands in a text are one id there, as the library does by default;
ids that are no token, and null ids, are an error in decoding; bytes that are no UTF-8
decode to replacement characters; repeated rows are encoded each; an empty table gives
an empty result. Other columns are carried along under their names; a clash with the
name of a new column is an error that names it. Pre-tokens are told apart by 64-bit
codes: with n distinct ones met by a worker, the chance of a clash is about n*n / 2**65.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from foliospark.llm.kernels import Texts, lists, slices, spread
from foliospark.llm.pretoken_spans import Encodings, ids_of
from foliospark.llm.pretokens import pieces

VOCABULARY = "byte_bpe_50k.json"
#: Compatible pairs that a worker remembers; all are forgotten when there are more.
PAIRS = 1 << 20
#: Ids decoded at a time.
IDS = 1 << 18


class Codec:
    """A merge table as what prefixes can end in."""

    def __init__(self, merges: list[tuple[bytes, bytes]], ids: dict[bytes, int]):
        self.bytes_of = {i: t for t, i in ids.items()}
        self.rank = {i: -1 for i in self.bytes_of}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, whole = ids[a], ids[b], ids[a + b]
            if whole in self.halves or max(self.rank[x], self.rank[y]) >= r:
                raise ValueError(f"not a table in which each token is merged once, after its halves: {a + b!r}")
            self.rank[whole], self.halves[whole], self.joined[x, y] = r, (x, y), r
        self.known: dict[tuple[int, int], bool] = {}
        whole = sorted(i for i, t in self.bytes_of.items() if len(t) == 1 or (i in self.halves and self.unmerged(*self.halves[i], self.rank[i])))
        self._automaton([(self.bytes_of[i], i) for i in whole])

    def unmerged(self, a: int, b: int, before: int) -> bool:
        """Whether no merge of a rank under ``before`` crosses from the end of a to the start of b.

        Undoes the merges at the seam, the latest first; what stands at the seam at a time
        may not have been joined by then.
        """
        joined, rank, halves = self.joined.get, self.rank, self.halves
        while True:
            if (r := joined((a, b))) is not None and r < before:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                before, a = ra, halves[a][1]
            else:  # of equal merges the left one is first, so the right one goes first here
                before, b = rb + 1, halves[b][0]

    def fits(self, a: int, b: int) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) >= PAIRS:
                self.known.clear()
            got = self.known[a, b] = self.unmerged(a, b, len(self.rank))
        return got

    def _automaton(self, tokens: list[tuple[bytes, int]]) -> None:
        """goto: (state, byte) -> state; ends: tokens that end in a state, the longest first."""
        goto: dict[int, int] = {}
        own: list[int] = [-1]
        into: list[tuple[int, int]] = [(0, 0)]
        depth = [0]
        for t, i in tokens:
            at = 0
            for b in t:
                to = goto.get(at << 8 | b)
                if to is None:
                    to = goto[at << 8 | b] = len(own)
                    own.append(-1)
                    into.append((at, b))
                    depth.append(depth[at] + 1)
                at = to
            own[at] = i
        back = [0] * len(own)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        for s in sorted(range(1, len(own)), key=depth.__getitem__):
            up, b = into[s]
            if up:
                f = back[up]
                while f and (f << 8 | b) not in goto:
                    f = back[f]
                back[s] = goto.get(f << 8 | b, 0)
            ends[s] = (((own[s], depth[s]),) if own[s] >= 0 else ()) + ends[back[s]]
        self.goto, self.back, self.ends = goto, back, ends

    def encode(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        goto, back, ends, fits = self.goto, self.back, self.ends, self.fits
        last, size, s = [-1], [0], 0
        for i, b in enumerate(word, 1):
            while (to := goto.get(s << 8 | b)) is None:
                if not s:
                    raise ValueError(f"no token for byte {b}")
                s = back[s]
            s = to
            for token, n in ends[s]:
                if n == i or fits(last[i - n], token):
                    last.append(token)
                    size.append(n)
                    break
        out, i = [], len(word)
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]


class Codes(Encodings):
    """The worker's table of pre-tokens, filled by a codec; and the bytes of every token."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: b for b, c in self.shown.items()}
        raw = lambda t: bytes(map(byte.__getitem__, t))
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in byte for c in t) and i not in self.added.values()}
        self.codec = Codec(merges, ids)
        self.words = pieces(path)
        held = self.codec.bytes_of | {i: t.encode() for t, i in self.added.items()}
        self.token = [held.get(i) for i in range(max(held) + 1)]
        self.token_size = np.array([-1 if t is None else len(t) for t in self.token], np.int64)
        self.token_first = np.cumsum(np.maximum(self.token_size, 0)) - np.maximum(self.token_size, 0)
        self.token_data = np.frombuffer(b"".join(t or b"" for t in self.token), np.uint8)

    def learn(self, code: np.ndarray, words: list[bytes]) -> None:
        ids = [self.codec.encode(w) for w in words]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(flat)), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        first = self.used + np.cumsum(size, dtype=np.int64) - size
        self.used += len(flat)
        self._put(code, first, size, np.zeros(len(code), np.uint8))

    def text_ids(self, text: str) -> list[int]:
        """Ids of one text that may hold added tokens."""
        out: list[int] = []
        for added, x in self.words.parts(text):
            out += [self.added[x]] if added else [i for w in self.words.find(x) for i in self.codec.encode(w.encode())]
        return out

    def column_ids(self, column: pa.Array) -> pa.Array:
        """Ids of every text of a column."""
        t = Texts(column)
        ids, off = ids_of(self, t)
        if any(pa.compute.any(pa.compute.match_substring(column, a)).as_py() for a in self.added):
            rows = [ids[off[i] : off[i + 1]] for i in range(t.n)]
            for i in np.flatnonzero(np.any([np.asarray(pa.compute.match_substring(column, a).fill_null(False)) for a in self.added], axis=0)):
                rows[i] = np.array(self.text_ids(column[int(i)].as_py()), np.uint32)
            ids, off = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return lists(ids.astype(np.int32), np.diff(off), pa.int32())

    def column_texts(self, column: pa.ListArray) -> pa.Array:
        """The text of every row of ids."""
        n = np.asarray(pa.compute.list_value_length(column).fill_null(0), dtype=np.int64)
        flat = pa.compute.list_flatten(column)
        ids = np.asarray(flat.fill_null(-1), dtype=np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.token) or (self.token_size[ids] < 0).any()):
            raise ValueError("ids without a token")
        size = self.token_size[ids]
        raw = self.token_data[spread(self.token_first[ids], size)].tobytes()
        off = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(n)])]
        return pa.array([raw[a:z].decode("utf-8", "replace") for a, z in zip(off[:-1], off[1:], strict=True)], pa.string())


@lru_cache(maxsize=2)
def codes(path: str) -> Codes:
    """One per worker and vocabulary file."""
    return Codes(path)


def _with_column(df: DataFrame, name: str, kind, read: str, run) -> DataFrame:
    """``df`` and a column that tasks work out from another one."""
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    inner = df.toDF(*[f"c_{i}" for i in range(len(df.columns))])
    at = f"c_{df.columns.index(read)}"

    out = inner.mapInArrow(lambda batches: run(batches, at), StructType([*inner.schema.fields, StructField("c_new", kind)]))
    return out.toDF(*df.columns, name)


def _stretches(ids: pa.ListArray) -> Iterator[tuple[int, int]]:
    """(start, rows) of stretches of rows that hold near IDS ids each."""
    total = np.cumsum(np.asarray(pa.compute.list_value_length(ids).fill_null(0), dtype=np.int64))
    at = 0
    while at < len(ids):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + IDS, side="right")))
        yield at, to - at
        at = to


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` and the token ids of each text (array of int)."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches, at):
        for b in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*b.columns, codes(path).column_ids(b.column(at))], [*b.schema.names, "c_new"])

    return _with_column(docs, ids_col, ArrayType(IntegerType(), False), text_col, run)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """``encoded`` and the text of each row of ids."""
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches, at):
        for b in (whole.slice(a, n) for whole in batches for a, n in _stretches(whole.column(at))):
            yield pa.RecordBatch.from_arrays([*b.columns, codes(path).column_texts(b.column(at))], [*b.schema.names, "c_new"])

    return _with_column(encoded, text_col, StringType(), ids_col, run)


def codec_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded."""
    both = decode(encode(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path=path).drop("text"), path=path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
