"""Evaluation corpora: checking manifests, first-wins dedup, even sampling, page picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.operators.ranks import prefix_sums, smallest
from foliospark.sources.writers import stored

# What a manifest row may hold.
FORMATS = ("pdf", "scan-pdf", "docx", "xlsx", "pptx", "html", "png", "jpg", "tiff")
TRUTH_TYPES = ("A", "B", "C", "D")
MOST_BYTES, MOST_PAGES = 8 << 20, 30


def validated(manifest: DataFrame, langs: tuple[str, ...] | None = None) -> DataFrame:
    """Manifest rows with ``reason``: null when the row is good, else the first fault."""
    checks: list[Column] = [
        F.when(F.col("id").isNull() | (F.col("id") == ""), "no id"),
        F.when(~F.coalesce(F.col("format").isin(*FORMATS), F.lit(False)), "format"),
        F.when(~F.coalesce(F.col("truth_type").isin(*TRUTH_TYPES), F.lit(False)), "truth type"),
        F.when(F.coalesce(F.col("size"), F.lit(0)) <= 0, "missing"),
        F.when(F.col("size") > MOST_BYTES, "too large"),
        F.when(F.col("pages") > MOST_PAGES, "too many pages"),
    ]
    if langs:
        checks.insert(2, F.when(~F.coalesce(F.col("lang").isin(*langs), F.lit(False)), "lang"))
    if "actual_sha256" in manifest.columns:
        checks.append(F.when(F.col("sha256") != F.col("actual_sha256"), "hash"))
    return manifest.withColumn("reason", F.coalesce(*checks))


def first_wins(rows: DataFrame, key: str = "sha256", order: str = "ord") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def unique_ids(rows: DataFrame, id_col: str = "id", order: str = "ord") -> DataFrame:
    """Ids that repeat get _2, _3, ... in order; numbers that make up an id some row has are passed over.

    A row's number is its place in one sorted row of the repeats of its id and the numbers
    that are taken, each standing where it pushes the repeats after it up by one. So no
    number is tried twice, and neither an id of many rows nor one with many numbers taken
    is one task's work. Rows agree in ``order`` nowhere within an id.
    """
    cols = rows.columns
    at = prefix_sums(rows, (id_col,), (order,), before="_k")
    first = at.where(F.col(id_col).isNull() | (F.col("_k") == 0)).select(*cols)
    again = at.where(F.col(id_col).isNotNull() & (F.col("_k") > 0)).withColumns({"_base": F.col(id_col), "_v": F.col("_k") - 1, "_of": F.lit(1)})
    numbered = F.regexp_extract(F.col(id_col), r"^(.*)_([1-9][0-9]{0,17})$", 2)
    taken = rows.select(F.regexp_extract(F.col(id_col), r"(?s)^(.*)_[1-9][0-9]{0,17}$", 1).alias("_base"), numbered.alias("_n")).where("_n <> ''").select("_base", F.col("_n").cast("long").alias("_n"))
    taken = taken.where("_n > 1").distinct().join(again.select("_base").distinct(), "_base", "left_semi")
    # a taken number n with j taken ones below it pushes up the repeats from the (n - 2 - j)th on
    pushes = prefix_sums(taken, ("_base",), ("_n",), before="_j").select("_base", (F.col("_n") - 2 - F.col("_j")).alias("_v"), F.lit(0).alias("_of"), "_n")
    both = again.drop("_k").withColumn("_n", F.lit(0).cast("long")).unionByName(pushes, allowMissingColumns=True)
    named = prefix_sums(both, ("_base",), ("_v", "_of", "_n"), before="_at").where("_of = 1")
    return first.unionByName(named.withColumn(id_col, F.concat_ws("_", "_base", (F.col("_at") + 2).cast("string"))).select(*cols))


def deduped_inputs(rows: DataFrame, key: str = "path", order: str = "ord") -> DataFrame:
    """Each key once, at its first place."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def round_robin(rows: DataFrame, *by: str, budget: int, key: str = "id", seed: int = 0, chosen: DataFrame | None = None) -> DataFrame:
    """``budget`` rows taken in turn from the strata, each in the order of a hash of its key.

    Rows already ``chosen`` (their keys) count against the budget and are not taken again.
    """
    if chosen is not None:
        chosen = chosen.select(key).distinct()
        budget = max(budget - rows.join(chosen, key, "left_semi").count(), 0)
        rows = rows.join(chosen, key, "left_anti")
    hashed = rows.withColumn("_h", F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string"))))
    return smallest(hashed, by, quotas(rows, by, budget), ("_h", key), "round").drop("_h")


def quotas(rows: DataFrame, by: tuple[str, ...], budget: int) -> DataFrame:
    """The strata and their ``quota``: how many rows each gives when they are taken in turn.

    All give as many as they have up to a level that the budget allows, found from how many
    strata have how many rows; those above it that come first give one more.
    """
    sizes = stored(rows.groupBy(*by).agg(F.count("*").alias("size")), "strata")
    # (size, strata of it, strata and rows in smaller ones): at most the square root of twice the rows
    kinds = prefix_sums(prefix_sums(sizes.groupBy("size").agg(F.count("*").alias("n")), (), ("size",), F.col("n"), "below", "all"), (), ("size",), F.col("n") * F.col("size"), "rows")
    left = F.col("all") - F.col("below")  # strata of this size and above
    prev = F.coalesce(F.lag("size").over(Window.orderBy("size")), F.lit(0))
    step = kinds.withColumns({"left": left, "prev": prev}).withColumn("filled", F.col("rows") + F.col("prev") * F.col("left"))
    level = step.where((F.col("filled") <= budget) & (F.lit(budget) < F.col("rows") + F.col("size") * F.col("left")))
    found = level.select((F.col("prev") + F.floor((budget - F.col("filled")) / F.col("left"))).alias("level"), "rows", "left").head()
    if found is None:  # the budget is as large as all there is
        return sizes.withColumnRenamed("size", "quota")
    more = budget - found["rows"] - found["level"] * found["left"]
    ranked = prefix_sums(sizes, (), tuple(F.col(c) for c in by), (F.col("size") > found["level"]).cast("long"), "_above")
    return ranked.withColumn("quota", F.least("size", F.lit(found["level"])) + ((F.col("size") > found["level"]) & (F.col("_above") < more)).cast("long")).drop("size", "_above")


def eligible_page(text: Column, page: Column, pages: Column) -> Column:
    """A page worth picking: enough text, no title page, no table of contents."""
    return (F.length(text) >= 200) & ~((page == 1) & (pages >= 3)) & (F.regexp_count(text, F.lit(r"\.{4,}")) < 3)


def page_runs(pages: DataFrame, n: int) -> DataFrame:
    """The first run of n following eligible pages of each document: (doc_id, first_page)."""
    w = Window.partitionBy("doc_id").orderBy("page")
    runs = pages.where("eligible").withColumn("_z", F.lead("page", n - 1).over(w) if n > 1 else F.col("page"))
    return runs.where(F.col("_z") == F.col("page") + n - 1).groupBy("doc_id").agg(F.min("page").alias("first_page"))


def finished_shards(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose file is there with the hash they state, and whose truth has a source."""
    return rows.where(F.col("truth_src").isNotNull()).join(files, ["path", "sha256"], "left_semi")


def layout_guess(blocks: DataFrame) -> DataFrame:
    """(doc_id, columns): two where a quarter of the text blocks, four at least, stand on the right."""
    right = F.count_if(F.col("x") > F.col("page_width") / 2)
    return blocks.groupBy("doc_id").agg(F.when((right >= 4) & (right >= 0.25 * F.count("*")), 2).otherwise(1).alias("columns"))
