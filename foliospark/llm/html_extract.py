"""HTML extraction: the main text of pages by the recurrent block labeller.

Every leaf block of the whole page is classified with the context of all others; blocks
labelled main text are joined by one space in page order, nothing else is dropped.

Defined cases: null or empty html gives an empty text; repeated rows are done each; a
page without blocks has an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.html_blocks import blocks
from foliospark.llm.kernels import slices
from foliospark.llm.labeller import trained


def main_texts(pages: list[str | None]) -> list[str]:
    """Main text of each page."""
    parsed = [blocks(p) for p in pages]
    keep = trained().label(parsed)
    return [" ".join(b.text for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(parsed, keep, strict=True)]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html", 2 << 20):
        text = main_texts(b.column("html").to_pylist())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array([len(x) for x in text], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
