"""Page quality: what each page holds, and pages that stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import letters_and_digits, strip

SPARSE = 0.2
FEW_CHARS = 50


def page_stats(nodes: DataFrame) -> DataFrame:
    """(doc_id, page, elements, chars): nodes of each page and the characters in them."""
    inner = F.when(F.col("items").isNotNull(), F.aggregate("items", F.lit(0), lambda n, x: n + F.length(strip(x)))).when(
        F.col("grid").isNotNull(), F.aggregate(F.flatten("grid"), F.lit(0), lambda n, x: n + F.length(strip(x)))
    )
    chars = F.coalesce(inner, F.length(strip("content")), F.lit(0))
    return nodes.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("elements"), F.sum(chars).cast("int").alias("chars"))


def page_qa(stats: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, elements, chars, status, percent) for all pages 1..N of each document.

    N is ``pages.pages``, else the largest page seen. The median is the upper one of the
    pages that have characters.
    """
    per = stats.groupBy("doc_id").agg(F.max("page").alias("_seen"), F.array_sort(F.collect_list(F.when(F.col("chars") > 0, F.col("chars")))).alias("_c"))
    if pages is not None:
        per = per.join(pages.select("doc_id", F.col("pages").alias("_n")), "doc_id", "left")
        per = per.withColumn("_seen", F.coalesce("_n", "_seen"))
    per = per.withColumn("median", F.when(F.size("_c") > 0, F.element_at("_c", (F.floor(F.size("_c") / 2) + 1).cast("int"))).otherwise(0))
    every = per.select("doc_id", "median", F.explode(F.sequence(F.lit(1), F.greatest("_seen", F.lit(1)))).alias("page"))
    out = every.join(stats, ["doc_id", "page"], "left").fillna(0, ["elements", "chars"])
    sparse = F.col("chars") < SPARSE * F.col("median")
    status = F.when((F.col("elements") == 0) & (F.col("chars") == 0), "blank").when(F.col("chars") == 0, "image-only").when(sparse, "low-density").otherwise("normal")
    percent = F.when(F.col("median") > 0, F.floor(F.col("chars") * 100 / F.col("median")).cast("int"))
    return out.select("doc_id", "page", "elements", "chars", status.alias("status"), percent.alias("percent"))


def text_density(page_texts: DataFrame) -> DataFrame:
    """(doc_id, density): characters per page of plain page texts."""
    return page_texts.groupBy("doc_id").agg(F.avg(F.length(strip("text"))).alias("density"))


def needs_ocr(kind: Column, mode: str, server_ok: bool, density: Column, force: bool = False) -> Column:
    """Whether a file is sent to text recognition, by its kind, the mode and its density."""
    on = F.lit(mode != "off" and server_ok)
    return (
        F.when(kind == "adapter", F.lit(False))
        .when(kind == "image", on)
        .when(F.lit(mode == "off" or not server_ok), F.lit(False))
        .when(F.lit(force or mode == "force"), F.lit(True))
        .when(density.isNull(), F.lit(False))
        .otherwise(density < FEW_CHARS)
    )


def empty_image(ok: Column, degraded: Column, kind: Column, text: Column) -> Column:
    """An image that went through but gave no letter or digit."""
    return (kind == "image") & ok & ~degraded & (letters_and_digits(text) == 0)


def ready_files(observations: DataFrame) -> DataFrame:
    """Files whose (mtime, size) equal those of the poll before."""
    w = Window.partitionBy("path").orderBy("poll")
    same = F.struct("mtime", "size") == F.lag(F.struct("mtime", "size")).over(w)
    return observations.withColumn("ready", F.coalesce(same, F.lit(False)))
