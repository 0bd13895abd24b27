"""Evaluation of extracted text against ground truth, and the grouped report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.metrics import anchors, heading_f1, kendall, multiset_f1, number_stats, plain_cer, plain_sim
from foliospark.functions.text import cjk_inner_spaces, compat_residual, md_headings, md_tables, norm_text, norm_ws, plain_numbers
from foliospark.operators.ranks import order_statistics

# Columns whose means the report gives, and statuses that count as done.
QUALITY = ("char_sim", "cer", "heading_f1", "cell_f1", "order_tau", "digit_f1")
DONE = ("ok", "degraded")
OCR_FORMATS = ("scan-pdf", "jpg", "png", "tiff")
DIGITS_LEAST = 30
ENGINE_ORDER: tuple[str, ...] = ("subject",)


def score(results: DataFrame, truths: DataFrame) -> DataFrame:
    """Results (id, engine, markdown) with the metrics of their truth.

    A metric whose part of the truth is null is null; digit metrics are null when neither
    side has a number. Results without truth keep null metrics.
    """
    t = truths.select(F.col("id"), F.col("text").alias("t_text"), F.col("headings").alias("t_headings"), F.col("paragraphs").alias("t_paragraphs"), F.col("tables").alias("t_tables"))
    out = results.join(t, "id", "left")
    both = F.col("t_text").isNotNull() & F.col("markdown").isNotNull()
    # parts that several metrics or their lambdas read are columns of their own
    out = out.withColumn("_p", norm_text("markdown")).withColumn("_t", norm_text("t_text"))
    truth_cells = F.transform("t_tables", lambda tb: F.transform(tb, lambda r: F.transform(r, norm_text)))
    flat = lambda c: F.filter(F.flatten(F.flatten(c)), lambda x: x != "")
    out = out.withColumns(
        {
            "_np": plain_numbers(F.col("_p")), "_nt": plain_numbers(F.col("_t")), "_hp": md_headings("markdown"), "_ht": F.transform("t_headings", norm_text), "_tp": md_tables("markdown"),
            "_ct": flat(truth_cells), "_at": anchors(F.col("_p"), F.col("t_paragraphs")),
        }
    ).withColumn("_cp", flat(F.col("_tp")))
    out = out.withColumn("_d", F.when(both, number_stats(F.col("_np"), F.col("_nt"))))
    digits = (F.col("_d.digit_n_truth") + F.col("_d.digit_n_pred")) > 0
    n_t, n_p = F.length("_t"), F.length("_p")
    return out.withColumns(
        {
            "char_sim": F.when(both, plain_sim(F.col("_p"), F.col("_t"))), "cer": F.when(both, plain_cer(F.col("_p"), F.col("_t"))),
            "length_ratio": F.when(both, F.when(n_t > 0, n_p / n_t).when(n_p == 0, 0.0).otherwise(F.lit(float("inf")))),
            "heading_f1": F.when(F.col("t_headings").isNotNull(), heading_f1("_hp", "_ht")),
            "cell_f1": F.when(F.col("t_tables").isNotNull(), multiset_f1(F.col("_cp"), F.col("_ct"))),
            "table_count_diff": F.when(F.col("t_tables").isNotNull(), F.size("_tp") - F.size("t_tables")),
            "order_tau": F.when(F.col("t_paragraphs").isNotNull(), kendall(F.col("_at"))),
            "compat_residual": compat_residual("markdown"), "cjk_inner_spaces": cjk_inner_spaces("markdown"),
            **{k: F.when(digits, F.col(f"_d.{k}")) for k in ("digit_f1", "digit_precision", "digit_recall", "digit_n_truth", "digit_n_pred")},
        }
    ).drop("_d", "_p", "_t", "_np", "_nt", "_hp", "_ht", "_tp", "_cp", "_ct", "_at", "t_text", "t_headings", "t_paragraphs", "t_tables")


def truths_from_blocks(blocks: DataFrame, with_headings: Column | None = None) -> DataFrame:
    """(doc_id, text, headings, heading_levels, paragraphs, tables) of truth blocks.

    Block rows are (doc_id, ord, kind, level, text, grid); empty blocks and rows go. Where
    ``with_headings`` is false the heading columns are null: not evaluated.
    """
    clean = F.transform("grid", lambda r: F.transform(r, norm_ws))
    rows = F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))
    b = blocks.withColumn("_t", norm_ws("text")).withColumn("_g", rows)
    flat = F.when(F.col("kind") == "table", F.array_join(F.transform("_g", lambda r: F.array_join(F.filter(r, lambda c: c != ""), " ")), " ")).otherwise(F.col("_t"))
    b = b.withColumn("_t", flat).where("_t <> ''")
    pick = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", F.col(c).alias("v"))))), lambda x: x["v"])
    flag = F.max(with_headings if with_headings is not None else F.lit(True))
    out = b.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "_t"))), lambda x: x["_t"]), " ").alias("text"), pick("heading", "_t").alias("headings"),
        pick("heading", "level").alias("heading_levels"), pick("paragraph", "_t").alias("paragraphs"), pick("table", "_g").alias("tables"), flag.alias("_f"),
    )
    return out.withColumn("headings", F.when(F.col("_f"), F.col("headings"))).withColumn("heading_levels", F.when(F.col("_f"), F.col("heading_levels"))).drop("_f")


def p95_place(n: Column) -> Column:
    """Of n sorted values the place int(0.95 n) where there are 20 or more, else the last."""
    return F.when(n >= 20, F.greatest(F.floor(n * 0.95), F.lit(1))).otherwise(n)


def times(results: DataFrame, by: tuple[str, ...], value: str = "wall_s") -> DataFrame:
    """(by, median_s, p95_s) of each group, exact, without a list of a group's values."""
    places = {"_lo": lambda n: F.floor((n + 1) / 2), "_hi": lambda n: F.ceil((n + 1) / 2), "_p95": p95_place}
    at = order_statistics(results, by, value, places)
    return at.select(*by, ((F.col("_lo") + F.col("_hi")) / 2).alias("median_s"), F.round("_p95", 1).alias("p95_s"))


def with_times(groups: DataFrame, results: DataFrame, *by: str) -> DataFrame:
    """Rows of groups with the times of their results."""
    t = times(results, by)
    t = t.select(*[F.col(c).alias(f"_t{i}") for i, c in enumerate(by)], "median_s", "p95_s")
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_t{i}"))
    return groups.join(t, same, "left").drop(*[f"_t{i}" for i in range(len(by))])


def summarise(results: DataFrame, *by: str) -> DataFrame:
    """Counts, rates, means and times of results for each group."""
    done = F.col("status").isin(*DONE)
    means = [F.avg(F.when(done, F.col(c))).alias(c) for c in QUALITY if c in results.columns]
    sums = [F.sum(F.when(done, F.col(c))).alias(c) for c in ("compat_residual", "cjk_inner_spaces") if c in results.columns]
    rtl = []
    if "rtl_visual_ratio" in results.columns:
        rtl = [F.concat_ws("/", F.count_if(F.col("rtl_visual_ratio") > 2 / 3).cast("string"), F.count("rtl_visual_ratio").cast("string")).alias("rtl_vis")]
    statuses = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("ok", "degraded", "fail", "timeout", "unsupported")]
    out = results.groupBy(*by).agg(
        F.count("*").alias("n"), (F.count_if(done) / F.count("*") * 100).alias("ok_percent"), *statuses, *means, *sums, *rtl,
    )
    return with_times(out, results, *by)


def markdown_table(report: DataFrame, *order: str) -> DataFrame:
    """(ord, line) of a report as a Markdown table; bars in cells are escaped, null is empty.

    A report has a row for each engine or group, so one task numbers its lines.
    """
    names = report.columns
    cells = [F.concat(F.lit(" "), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("|"), F.lit("\\|")), F.lit(" |")) for c in names]
    body = report.select((F.row_number().over(Window.orderBy(*order)) + 1).alias("ord"), F.concat(F.lit("|"), *cells).alias("line"))
    head = F.array(F.lit("| " + " | ".join(names) + " |"), F.lit("|" + "---|" * len(names)))
    return report.sparkSession.range(1).select(F.posexplode(head).alias("ord", "line")).unionByName(body)


def grouped_report(results: DataFrame, dims: tuple[str, ...] = ("format", "lang", "domain", "truth_type")) -> DataFrame:
    """One row for each engine, and for each engine and value of a dimension (null is one), in one pass."""
    sets = [["engine"], *(["engine", d] for d in dims)]
    cols = ["engine", *dims]
    named = F.coalesce(*[F.when(F.grouping(d) == 0, F.lit(d)) for d in dims], F.lit("all"))
    done = F.col("status").isin(*DONE)
    g = results.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in cols])
    return g.agg(F.count("*").alias("n"), F.count_if(done).alias("n_done"), *[F.avg(F.when(done, F.col(c))).alias(c) for c in QUALITY if c in results.columns], F.percentile("wall_s", F.lit(0.5)).alias("median_s"), named.alias("dimension"))


def common_ids(results: DataFrame) -> DataFrame:
    """Ids that every engine has done."""
    engines = results.agg(F.count_distinct("engine").alias("n_engines"))
    per = results.where(F.col("status").isin(*DONE)).groupBy("id").agg(F.count_distinct("engine").alias("k"))
    return per.join(F.broadcast(engines), F.col("k") == F.col("n_engines")).select("id")


def on_common(results: DataFrame) -> DataFrame:
    """Results on the ids that every engine has done."""
    return results.join(common_ids(results), "id", "left_semi")


def pairwise(results: DataFrame, baseline: str) -> DataFrame:
    """Each engine against the baseline on the ids that both have done."""
    done = results.where(F.col("status").isin(*DONE))
    base = done.where(F.col("engine") == baseline).select("id", *[F.col(c).alias(f"base_{c}") for c in ("char_sim", "cer", "wall_s")])
    both = done.where(F.col("engine") != baseline).join(base, "id")
    mean = lambda c: [F.avg(c).alias(c), F.avg(f"base_{c}").alias(f"base_{c}")]
    return both.groupBy("engine").agg(F.count("*").alias("n"), *mean("char_sim"), *mean("cer"), F.percentile("wall_s", F.lit(0.5)).alias("median_s"), F.percentile("base_wall_s", F.lit(0.5)).alias("base_median_s"))


def digit_dense(results: DataFrame, truths: DataFrame) -> DataFrame:
    """Results on documents of many numbers whose truth is whole."""
    partial = truths.where(F.coalesce(F.col("note")["math_stripped"], F.col("note")["wikipedia_cleanup"]).isNotNull()).select("id")
    dense = results.where(F.col("digit_n_truth") >= DIGITS_LEAST).select("id").distinct()
    return results.join(dense, "id", "left_semi").join(partial, "id", "left_anti")


def by_channel(results: DataFrame) -> DataFrame:
    """Summary by engine and channel: text recognition or text layer."""
    channel = F.when(F.col("format").isin(*OCR_FORMATS), "ocr").otherwise("text-layer")
    return summarise(results.withColumn("channel", channel), "engine", "channel")


def worst(results: DataFrame, metric: str = "char_sim", n: int = 30) -> DataFrame:
    """The n results with the lowest metric, ties by id."""
    return results.where(F.col(metric).isNotNull()).orderBy(metric, "id").limit(n)


def engine_order(c: str = "engine") -> list[Column]:
    """Display order of engines: the known ones first, then by name."""
    rank = F.lit(len(ENGINE_ORDER))
    for i, name in enumerate(ENGINE_ORDER):
        rank = F.when(F.col(c) == name, i).otherwise(rank)
    return [rank, F.col(c)]


def rescored_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Mean and largest change of similarity between two scorings."""
    both = old.select("engine", "id", F.col("char_sim").alias("was")).join(new.select("engine", "id", "char_sim"), ["engine", "id"])
    return both.agg(F.count("*").alias("n"), F.avg(F.col("char_sim") - F.col("was")).alias("mean_change"), F.max(F.abs(F.col("char_sim") - F.col("was"))).alias("largest_change"))


def to_retry(results: DataFrame) -> DataFrame:
    """(engine, ids, n): what failed and may be tried again."""
    bad = results.where(~F.col("status").isin(*DONE, "unsupported"))
    return bad.groupBy("engine").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.count("*").alias("n"))


def counts(df: DataFrame, *by: str) -> DataFrame:
    """Value counts, most frequent first."""
    return df.groupBy(*by).count().orderBy(F.desc("count"), *by)
