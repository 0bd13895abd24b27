"""Mixing sources to target weights: iterative proportional fitting, then sampling.

The corpus becomes a table of token counts (of the tokenizer) by source, language and
topic. Raking scales its cells until the three marginals meet their targets; the rate of a
cell is its fitted share of the token budget over its tokens, bounded by one (a full cell
takes part in no further scaling). A document is sampled when a hash of its id falls below
its cell's rate.

A marginal's target is given as shares by category (categories that are not named divide
what is left by their tokens; those that have no tokens get none) or as a power that
tempers its shares (one keeps them, zero makes them flat). Only the cell table is fitted: on
the driver up to CELLS cells (checked), beyond that as DataFrames written every round; both
run the same rounds and stop at the same change.

Topics are fitted to every document: k-means over hashed counts of the longer words, less
the mean of the document's language (by its hash, one of CLASSES), so that topics do not
repeat the languages. Each pass adds up whole numbers per task, so the result depends on
neither partitions nor repeated tasks; what comes to the driver is TOPICS and CLASSES rows
of DIMS sums.

Defined cases: nulls in source or language are categories of their own; null texts have
no tokens; texts without longer words have topic 0; rows that repeat an id are sampled
together, rows without one by their text; an empty table gives an empty result; further
columns are kept whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import U64, Texts, Words, cuts, give_back
from foliospark.llm.pretoken_spans import encodings
from foliospark.llm.shared import done_with, written
from foliospark.llm.token_counts import VOCABULARY, counts

CELLS = 200_000
TOPICS, DIMS, CLASSES = 8, 128, 64
#: Passes of k-means at most, and documents that its first centres are chosen among.
PASSES, FIRST = 8, 64
#: Least bytes of the words that topics are told by; a unit vector's length in whole numbers.
LONG, UNIT = 6, 1000

Target = float | Mapping[str | int | None, float]


@dataclass(frozen=True)
class Mix:
    """For each marginal the target shares, or a power that tempers its own; the part of
    tokens to take, rounds, seed."""

    source: Target = 0.5
    lang: Target = 0.7
    topic: Target = 0.8
    budget: float = 0.5
    rounds: int = 200
    seed: int = 17


def word_vectors(column: pa.Array) -> np.ndarray:
    """Roots of the counts of longer words in DIMS hashed dimensions, of length UNIT, whole."""
    out = np.zeros((len(column), DIMS), np.int16)
    for at, rows in cuts(column):
        w = Words(Texts(column.slice(at, rows)), lower=True)
        long_ = (w.end - w.start) >= LONG
        each = np.bincount(w.doc()[long_] * DIMS + (w.code[long_] % U64(DIMS)).astype(np.int64), minlength=rows * DIMS).reshape(-1, DIMS)
        n = np.maximum(each.sum(axis=1, keepdims=True), 1)
        out[at : at + rows] = np.rint(UNIT * np.sqrt(each / n))
    return out


def _tokens(column: pa.Array, path: str) -> np.ndarray:
    e = encodings(path)
    return np.concatenate([np.zeros(0, np.int64), *(counts(e, column.slice(at, rows), path) for at, rows in cuts(column))])


def _flat(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _measure(text: Column, path: str) -> Column:
    def run(column: pa.Array) -> pa.Array:
        column = _flat(column)
        out = pa.StructArray.from_arrays([pa.array(_tokens(column, path)), pa.array([x.tobytes() for x in word_vectors(column)], pa.binary())], ["tokens", "words"])
        give_back()
        return out

    return F.arrow_udf(run, "struct<tokens:long,words:binary>")(text)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(len(column), DIMS).astype(np.float64)


@dataclass(frozen=True)
class Topics:
    """Means of the language classes and centres around them; all numbers are whole."""

    means: np.ndarray
    centres: np.ndarray

    def of(self, vectors: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """The nearest centre; whole numbers, so every sum is exact in any order."""
        if not len(self.centres):
            return np.zeros(len(vectors), np.int64)
        far = (self.centres**2).sum(axis=1) - 2 * ((vectors - self.means[classes]) @ self.centres.T)
        return np.where(vectors.any(axis=1), far.argmin(axis=1), 0)


def _class(lang: Column) -> Column:
    return F.pmod(F.xxhash64(lang), F.lit(CLASSES)).cast("int")


def _sums(model: Topics | None):
    """Per task the sums of vectors: by language class, or less its mean by topic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = CLASSES if model is None else TOPICS
        total, many = np.zeros((n, DIMS)), np.zeros(n, np.int64)
        for b in batches:
            v, k = _vectors(b.column("k_words")), np.asarray(b.column("k_class"), dtype=np.int64)
            live = v.any(axis=1)
            v, k = v[live], k[live]
            at = k
            if model is not None:
                at, v = model.of(v, k), v - model.means[k]
            for g in np.unique(at):
                total[g] += v[at == g].sum(axis=0)
            many += np.bincount(at, minlength=n)
        at = np.arange(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, DIMS)), pa.array(np.tile(np.arange(DIMS), n)), pa.array(total.ravel().astype(np.int64)), pa.array(np.repeat(many, DIMS))], ["g", "dim", "sum", "n"]
        )

    return run


def _means(vectors: DataFrame, model: Topics | None) -> tuple[np.ndarray, np.ndarray]:
    n = CLASSES if model is None else TOPICS
    got = vectors.mapInArrow(_sums(model), "g long, dim long, sum long, n long").groupBy("g", "dim").agg(F.sum("sum").alias("sum"), F.sum("n").alias("n")).collect()  # n * DIMS rows
    mean, many = np.zeros((n, DIMS)), np.zeros(n, np.int64)
    for r in got:
        mean[r.g, r.dim] = round(r["sum"] / max(r.n, 1))
        many[r.g] = r.n
    return mean, many


def fit_topics(measured: DataFrame) -> Topics:
    """k-means over all rows of (k_words, k_class)."""
    vectors = measured.select("k_words", "k_class")
    means, _ = _means(vectors, None)
    some = vectors.where(F.col("k_words") != F.lit(bytes(2 * DIMS))).orderBy(F.xxhash64("k_words"), "k_words", "k_class").limit(FIRST).toPandas()
    start = np.unique(_vectors(pa.array(some["k_words"].map(bytes).tolist(), pa.binary())) - means[some["k_class"].to_numpy(np.int64)], axis=0) if len(some) else np.zeros((0, DIMS))
    centres = start[:1]
    while len(centres) < min(TOPICS, len(start)):  # the farthest from those already taken
        centres = np.vstack([centres, start[((start[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).argmax()]])
    model = Topics(means, centres)
    for _ in range(PASSES if len(centres) else 0):
        moved, many = _means(vectors, model)
        nxt = np.where((many > 0)[: len(centres), None], moved[: len(centres)], centres)
        if (nxt == centres).all():
            break
        centres = nxt
        model = Topics(means, centres)
    return model


def _topic(model: Topics, words: Column, lang_class: Column, text: bool = False) -> Column:
    """The topic from stored vectors, or from the text itself."""

    def run(column: pa.Array, kind: pa.Array) -> pa.Array:
        column = _flat(column)
        v = word_vectors(column).astype(np.float64) if text else _vectors(column)
        if text:
            give_back()
        return pa.array(model.of(v, np.asarray(_flat(kind), dtype=np.int64)).astype(np.int32))

    return F.arrow_udf(run, "int")(words, lang_class)


def target_shares(mass: np.ndarray, names: list, target: Target) -> np.ndarray:
    """What part of the budget each category is to have."""
    if isinstance(target, Mapping):
        named = np.array([float(target.get(x, -1)) for x in names])
        share = np.where((mass > 0) & (named >= 0), np.maximum(named, 0), 0)
        other = (mass > 0) & (named < 0)
        if other.any():
            share[other] = max(0.0, 1 - share.sum()) * mass[other] / mass[other].sum()
    else:
        share = np.where(mass > 0, np.maximum(mass, 1) ** target, 0)
    return share / max(share.sum(), 1e-300)


def rake(cells: pd.DataFrame, dims: list[str], aims: list[Target], budget: float, rounds: int) -> np.ndarray:
    """Rates of the cells (tokens in ``cells.tokens``), between 0 and 1."""
    mass = cells["tokens"].to_numpy(float)
    total = mass.sum()
    if not total:
        return np.zeros(len(cells))
    codes, targets = [], []
    for d, aim in zip(dims, aims, strict=True):
        code, names = pd.factorize(cells[d], use_na_sentinel=False)
        codes.append(code)
        targets.append(budget * total * target_shares(np.bincount(code, mass), [None if pd.isna(x) else x for x in names], aim))
    want = mass * budget
    for _ in range(rounds):
        before = want.copy()
        for code, target in zip(codes, targets, strict=True):
            full = want >= mass
            held = np.bincount(code, np.where(full, want, 0), len(target))
            free = np.bincount(code, np.where(full, 0, want), len(target))
            room = np.maximum(target - held, 0)
            scale = np.divide(room, free, out=np.ones_like(free), where=free > 0)
            over = held > target
            down = np.divide(target, held + free, out=np.ones_like(free), where=(held + free) > 0)
            want = np.where(over[code], want * down[code], np.where(full, want, want * scale[code]))
            want = np.minimum(want, mass)
        if np.abs(want - before).max() <= 1e-9 * total:
            break
    return np.divide(want, mass, out=np.zeros_like(want), where=mass > 0)


def _shares(by: DataFrame, aim: Target, kind: str) -> DataFrame:
    """``target_shares`` of (k_t, mass); adds ``share``."""
    if isinstance(aim, Mapping):
        given = F.broadcast(by.sparkSession.createDataFrame([(k, float(v)) for k, v in aim.items()], f"k_g {kind}, named double"))
        x = by.join(given, F.col("k_t").eqNullSafe(F.col("k_g")), "left").withColumn("mass", F.col("mass").cast("double"))
        sums = x.agg(F.sum(F.when(F.col("mass") > 0, F.col("named"))).alias("a"), F.sum(F.when(F.col("named").isNull(), F.col("mass"))).alias("b")).head()
        left = max(0.0, 1 - (sums.a or 0.0)) / (sums.b or 1.0)
        x = x.withColumn("share", F.when(F.col("mass") > 0, F.coalesce("named", F.lit(left) * F.col("mass"))).otherwise(0.0))
    else:
        x = by.withColumn("share", F.when(F.col("mass") > 0, F.pow("mass", F.lit(float(aim)))).otherwise(0.0))
    norm = x.agg(F.sum("share")).head()[0] or 1.0
    return x.withColumn("share", F.col("share") / F.lit(float(norm)))


def rake_frames(cells: DataFrame, dims: list[str], aims: list[Target], budget: float, rounds: int) -> DataFrame:
    """``rake`` for cell tables that are too large for the driver; adds ``rate``.

    The sums of a marginal are sent to every task up to CELLS categories (checked).
    """
    total = cells.agg(F.sum("tokens")).head()[0] or 0
    goals = []
    for d, aim in zip(dims, aims, strict=True):
        by = cells.groupBy(F.col(d).alias("k_t")).agg(F.sum("tokens").alias("mass"))
        goal = written(_shares(by, aim, cells.schema[d].dataType.simpleString()).select("k_t", (F.lit(float(budget * total)) * F.col("share")).alias("target")), "targets")
        goals.append((d, goal, goal.count() <= CELLS))
    now = cells.withColumn("want", F.col("tokens") * F.lit(float(budget)))
    for _ in range(rounds):
        last, now = now, now.withColumn("before", F.col("want"))
        for d, goal, few in goals:
            by = now.groupBy(F.col(d).alias("k_d")).agg(F.sum("want").alias("sum"), F.sum(F.when(F.col("want") >= F.col("tokens"), F.col("want")).otherwise(0.0)).alias("held"))
            by = by.join(goal, F.col("k_d").eqNullSafe(F.col("k_t"))).drop("k_t")
            joined = now.join(F.broadcast(by) if few else by, now[d].eqNullSafe(by["k_d"]))
            free = F.col("sum") - F.col("held")
            scale = F.when(F.col("held") > F.col("target"), F.col("target") / F.col("sum")).when((F.col("want") >= F.col("tokens")) | (free <= 0), 1.0).otherwise(F.greatest(F.col("target") - F.col("held"), F.lit(0.0)) / free)
            now = joined.withColumn("want", F.least(F.col("want") * scale, F.col("tokens").cast("double"))).select(*cells.columns, "want", "before")
        now = written(now, "raked")
        moved = now.agg(F.max(F.abs(F.col("want") - F.col("before")))).head()[0] or 0.0
        done_with(last)
        if moved <= 1e-9 * total:
            break
    done_with(*(goal for _, goal, _ in goals))
    return now.withColumn("rate", F.when(F.col("tokens") > 0, F.col("want") / F.col("tokens")).otherwise(0.0)).drop("want", "before")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", seed: int = 17, path: str | None = None) -> DataFrame:
    """Per row k_id, k_source, k_lang, k_class, k_tokens, k_words and k_draw (from 0 to 1)."""
    x = docs.toDF(*[f"c_{i}" for i in range(len(docs.columns))])
    at = {c: F.col(f"c_{docs.columns.index(c)}") for c in (id_col, text_col, source_col, lang_col)}
    x = x.select(
        at[id_col].cast("long").alias("k_id"), at[source_col].cast("string").alias("k_source"), at[lang_col].cast("string").alias("k_lang"), _class(at[lang_col].cast("string")).alias("k_class"),
        _draw(at[id_col], at[text_col], seed).alias("k_draw"), _measure(at[text_col], path or public_tokenizers.path(VOCABULARY)).alias("k_m"),
    )
    return written(x.select("*", F.col("k_m.tokens").alias("k_tokens"), F.col("k_m.words").alias("k_words")).drop("k_m"), "measured")


def _draw(id_: Column, text: Column, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(id_.cast("string"), text, F.lit("")), F.lit(seed)), 11) / F.lit(float(1 << 53))


class Plan:
    """The mix fitted to a corpus: measures, topics, and the rate of each cell."""

    def __init__(self, docs: DataFrame, mix: Mix | None = None, cells_limit: int | None = None, **columns: str):
        self.mix = mix = mix or Mix()
        self.rows = measured(docs, seed=mix.seed, **columns)
        self.topics = fit_topics(self.rows)
        dims, aims = ["k_source", "k_lang", "k_topic"], [mix.source, mix.lang, mix.topic]
        self.placed = self.rows.withColumn("k_topic", _topic(self.topics, F.col("k_words"), F.col("k_class")))
        cells = written(self.placed.groupBy(*dims).agg(F.sum("k_tokens").alias("tokens")), "cells")
        if cells.count() <= (CELLS if cells_limit is None else cells_limit):
            table = cells.orderBy(*dims).toPandas()
            table["rate"] = rake(table, dims, aims, mix.budget, mix.rounds)
            rows = [(r.k_source, r.k_lang, int(r.k_topic), float(r.rate)) for r in table.astype(object).where(table.notna(), None).itertuples()]
            self.rates = F.broadcast(docs.sparkSession.createDataFrame(rows, "r_source string, r_lang string, r_topic int, k_rate double"))
            done_with(cells)
        else:
            self.rates = rake_frames(cells, dims, aims, mix.budget, mix.rounds).select(F.col("k_source").alias("r_source"), F.col("k_lang").alias("r_lang"), F.col("k_topic").alias("r_topic"), F.col("rate").alias("k_rate"))

    def rated(self, rows: DataFrame) -> DataFrame:
        """Rows of k_source, k_lang, k_topic and k_draw with k_rate and k_sampled."""
        on = F.col("k_source").eqNullSafe(F.col("r_source")) & F.col("k_lang").eqNullSafe(F.col("r_lang")) & (F.col("k_topic") == F.col("r_topic"))
        return rows.join(self.rates, on).withColumn("k_sampled", F.col("k_draw") < F.col("k_rate"))


def sampled(docs: DataFrame, mix: Mix | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", cells_limit: int | None = None) -> DataFrame:
    """The sampled documents, columns as they came."""
    plan = Plan(docs, mix, cells_limit, id_col=id_col, text_col=text_col, source_col=source_col, lang_col=lang_col)
    names = docs.columns
    x = docs.toDF(*[f"c_{i}" for i in range(len(names))])
    at = {c: F.col(f"c_{names.index(c)}") for c in (id_col, text_col, source_col, lang_col)}
    lang = at[lang_col].cast("string")
    x = x.select("*", at[source_col].cast("string").alias("k_source"), lang.alias("k_lang"), _draw(at[id_col], at[text_col], plan.mix.seed).alias("k_draw"), _topic(plan.topics, at[text_col], _class(lang), text=True).alias("k_topic"))
    out = plan.rated(x).where("k_sampled").select(*[f"c_{i}" for i in range(len(names))]).toDF(*names)
    done_with(plan.rows)
    return out


def mixing_plan(docs: DataFrame, mix: Mix | None = None, cells_limit: int | None = None) -> DataFrame:
    """Per document: doc_id, source, lang, topic, n_tokens, rate, sampled."""
    plan = Plan(docs.select("doc_id", "text", "source", "lang"), mix, cells_limit)
    out = {"doc_id": "k_id", "source": "k_source", "lang": "k_lang", "topic": "k_topic", "n_tokens": "k_tokens", "rate": "k_rate", "sampled": "k_sampled"}
    return plan.rated(plan.placed).select(*[F.col(v).alias(k) for k, v in out.items()])
