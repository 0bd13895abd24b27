"""Fidelity metrics between two texts or their parts, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliospark.functions.text import cjk_ratio, col, edit_distance, let, norm_text, numbers, token_distance, tokens

#: The heading match; the beginning of a paragraph that is looked for, and the least of it.
HEADING_MATCH = 0.85
ANCHOR, ANCHOR_LEAST = 40, 12


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of two plain strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def char_sim(pred: str | Column, truth: str | Column) -> Column:
    """Character similarity of the normalised texts."""
    return plain_sim(norm_text(pred), norm_text(truth))


def plain_sim(p: Column, t: Column) -> Column:
    """As ``similarity``, for long normalised texts."""
    longer = F.greatest(F.length(p), F.length(t))
    return F.when(longer == 0, 1.0).when((F.length(p) == 0) | (F.length(t) == 0), 0.0).otherwise(1 - edit_distance(p, t) / longer)


def cer(pred: str | Column, truth: str | Column) -> Column:
    """Error rate: by character where the truth is mostly CJK, else by word; at most 1."""
    return plain_cer(norm_text(pred), norm_text(truth))


def plain_cer(p: Column, t: Column) -> Column:
    """As ``cer``, for normalised texts."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s", "")
    by_char = edit_distance(bare(p), bare(t)) / F.greatest(F.length(bare(t)), F.lit(1))
    by_word = token_distance(tokens(p), tokens(t)) / F.greatest(F.size(tokens(t)), F.lit(1))
    some = F.when(cjk_ratio(t) > 0.3, by_char).otherwise(by_word)
    return F.when(F.length(t) == 0, F.when(F.length(p) == 0, 0.0).otherwise(1.0)).otherwise(F.least(some, F.lit(1.0)))


def precision(tp: Column, fp: Column, fn: Column) -> Column:
    return F.when(tp + fp > 0, tp / (tp + fp)).when(fn == 0, 1.0).otherwise(0.0)


def recall(tp: Column, fn: Column) -> Column:
    return F.when(tp + fn > 0, tp / (tp + fn)).otherwise(1.0)


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def shared_count(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays of strings: one pass over both, sorted together."""
    tagged = lambda xs, side: F.transform(xs, lambda x: F.struct(x.alias("v"), F.lit(side).alias("s")))
    start = F.struct(F.lit(None).cast("string").alias("v"), F.lit(0).alias("free"), F.lit(0).alias("n"))

    def step(state: Column, x: Column) -> Column:
        free = F.when(state["v"].eqNullSafe(x["v"]), state["free"]).otherwise(0)
        hit = ((x["s"] == 1) & (free > 0)).cast("int")
        return F.struct(x["v"].alias("v"), (free + F.when(x["s"] == 0, 1).otherwise(0) - hit).alias("free"), (state["n"] + hit).alias("n"))

    return F.aggregate(F.array_sort(F.concat(tagged(a, 0), tagged(b, 1))), start, step, lambda x: x["n"])


def multiset_f1(pred: Column, truth: Column) -> Column:
    """F score of the multiset intersection; 1 when both are empty."""

    def scored(tp: Column) -> Column:
        p = precision(tp, F.size(pred) - tp, F.size(truth) - tp)
        return F.when((F.size(pred) == 0) & (F.size(truth) == 0), 1.0).otherwise(f_score(p, recall(tp, F.size(truth) - tp)))

    return let(shared_count(pred, truth), scored)


def cell_f1(pred: Column, truth: Column) -> Column:
    """Cells of all tables as multisets of exact texts; empty cells do not count."""
    flat = lambda t: F.filter(F.flatten(F.flatten(t)), lambda c: c != "")
    return multiset_f1(flat(pred), flat(truth))


def digit_stats(pred: str | Column, truth: str | Column) -> Column:
    """struct of digit_f1, digit_precision, digit_recall, digit_n_truth, digit_n_pred."""
    return number_stats(numbers(pred), numbers(truth))


def number_stats(p: Column, t: Column) -> Column:
    """As ``digit_stats``, for arrays of numbers (columns: lambdas read them once for each element)."""
    n_p, n_t = F.size(p), F.size(t)

    def scored(tp: Column) -> Column:
        prec = F.when(n_p > 0, tp / n_p).when(n_t == 0, 1.0).otherwise(0.0)
        rec = F.when(n_t > 0, tp / n_t).when(n_p == 0, 1.0).otherwise(0.0)
        return F.struct(
            F.bround(f_score(prec, rec), 4).alias("digit_f1"), F.bround(prec, 4).alias("digit_precision"), F.bround(rec, 4).alias("digit_recall"),
            n_t.alias("digit_n_truth"), n_p.alias("digit_n_pred"),
        )

    return let(shared_count(p, t), scored)


def alike(a: Column, b: Column) -> Column:
    """``similarity`` where it is at least HEADING_MATCH, else null: distances beyond that are not worked out."""
    longer = F.greatest(F.length(a), F.length(b))
    most = F.floor(longer * (1 - HEADING_MATCH)).cast("int") + 1
    far = F.abs(F.length(a) - F.length(b)) > most
    distance = F.when(a == b, 0).when(~far, F.call_function("levenshtein", a, b, most))
    s = F.when(longer == 0, 1.0).when(distance >= 0, 1 - distance / longer)
    return F.when(s >= HEADING_MATCH, s)


def heading_tp(pred: Column, truth: Column) -> Column:
    """Greedy one-to-one matches: each heading takes the most similar free truth heading.

    The pairs that may match are found first, each once; only these are gone through then.
    """

    def near(p: Column) -> Column:
        scored = F.transform(truth, lambda t, i: F.struct(alike(p, t).alias("s"), (-i).alias("i")))
        return F.filter(scored, lambda x: x["s"].isNotNull())

    def take(state: Column, best: Column) -> Column:
        hit = best.isNotNull()
        return F.struct(F.when(hit, F.array_append(state["used"], best["i"])).otherwise(state["used"]).alias("used"), (state["tp"] + hit.cast("int")).alias("tp"))

    def step(state: Column, found: Column) -> Column:
        free = F.filter(found, lambda x: ~F.array_contains(state["used"], x["i"]))
        return let(F.array_max(free), lambda best: take(state, best))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.lit(0).alias("tp"))
    return F.aggregate(F.filter(F.transform(pred, near), lambda found: F.size(found) > 0), start, step, lambda s: s["tp"])


def heading_f1(pred: str | Column, truth: str | Column) -> Column:
    return let(F.transform(col(pred), norm_text), lambda p: let(F.transform(col(truth), norm_text), lambda t: heading_score(p, t)))


def heading_score(pred: Column, truth: Column) -> Column:
    """As ``heading_f1``, for normalised headings (columns: lambdas read them once for each element)."""

    def scored(tp: Column) -> Column:
        p = precision(tp, F.size(pred) - tp, F.size(truth) - tp)
        return F.when((F.size(pred) == 0) & (F.size(truth) == 0), 1.0).otherwise(f_score(p, recall(tp, F.size(truth) - tp)))

    return let(heading_tp(pred, truth), scored)


def kendall(positions: Column) -> Column:
    """Kendall's tau of an array of positions against its own order; ties do not count."""
    add = lambda a: F.aggregate(a, F.lit(0).cast("double"), lambda s, x: s + x)

    def signs(xs: Column) -> Column:
        """Signs of the pairs of each place with the later ones: their sum, and how many are not 0."""
        later = lambda i: F.slice(xs, i + 2, F.greatest(F.size(xs) - i - 1, F.lit(0)))
        both = F.transform(xs, lambda x, i: F.transform(later(i), lambda y: F.signum((y - x).cast("double"))))
        return let(F.transform(both, lambda r: F.struct(add(r).alias("s"), add(F.transform(r, F.abs)).alias("n"))), lambda rs: F.struct(add(rs["s"]).alias("s"), add(rs["n"]).alias("n")))

    tau = lambda t: F.when(t["n"] == 0, 1.0).otherwise(t["s"] / t["n"])
    return let(positions, lambda xs: F.when(F.size(xs) >= 2, let(signs(xs), tau)))


def anchors(plain: Column, paragraphs: Column) -> Column:
    """Where the beginnings of the paragraphs stand in a normalised text."""
    keys = F.filter(F.transform(paragraphs, norm_text), lambda k: F.length(k) >= ANCHOR_LEAST)
    found = lambda text: F.transform(keys, lambda k: F.position(F.left(k, F.lit(ANCHOR)), text))
    return F.filter(let(plain, found), lambda i: i > 0)


def order_tau(pred: str | Column, paragraphs: str | Column) -> Column:
    """Order of the truth's paragraphs in the output, by where each one's beginning stands."""
    return kendall(anchors(norm_text(pred), col(paragraphs)))
