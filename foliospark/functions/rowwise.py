"""Functions of single rows as Arrow functions that hold few results at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows, and characters or bytes read, after which results go out.
OUT_ROWS, OUT_READ = 64, 1 << 20


def pieces(fn: Callable, kind: pa.DataType, batches: Iterable[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """Results of ``fn`` for all rows of all batches, in order, few at a time."""
    for columns in batches:
        held, read = [], 0
        for row in zip(*columns, strict=True):
            values = [x.as_py() for x in row]
            held.append(fn(*values))
            read += sum(len(v) for v in values if isinstance(v, (str, bytes)))
            if len(held) >= OUT_ROWS or read >= OUT_READ:
                yield pa.array(held, kind)
                held, read = [], 0
        if held:
            yield pa.array(held, kind)


def by_row(fn: Callable, returns: T.DataType) -> Callable[..., Column]:
    """Arrow function of ``fn`` (a row's values in, its result out: a struct's as a dict).

    An Arrow batch has up to 10,000 rows. Their values are made Python objects one row at a
    time, and results leave in pieces, so that memory does not grow with the rows of a batch.
    """
    kind = to_arrow_type(returns)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        yield from pieces(fn, kind, (b if isinstance(b, tuple) else (b,) for b in batches))

    return F.arrow_udf(run, returns)
