"""Structure trees as a relation: every object of a JSON tree with its interval of places.

A node row is (doc_id, pre, upto, parent, depth, slot, many, plain, type, level, page,
content, attrs). ``pre`` numbers a document's nodes from 0 in reading order, ``upto`` is
the last place below a node, so "all below" is ``pre`` between two numbers, and moving a
subtree is arithmetic on them. ``slot`` is the member of the parent that holds the node,
``many`` says whether that member is an array; ``plain`` nodes are reached through ``kids``
alone. ``attrs`` has all members that hold no objects, as JSON texts by name.

Trees need no schema and may have any shape: members are read in the order of their names
(a VARIANT keeps no other), arrays inside arrays are walked and come out as one array,
and values that stand beside objects in an array are left out. Keys of documents are
unique and not null; a null or unreadable tree has no nodes; an array on top gives
several nodes without parent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.text import LONG_ITEM, NUMBERED_ITEM, heading_is_noise, letters_and_digits, strip, strip_list_bullet
from foliospark.operators.blocks import grid_markdown
from foliospark.sources.writers import stored

#: Columns of a node row; arrays and objects are walked up to 200 levels deep.
NODE = ("doc_id", "pre", "upto", "parent", "depth", "slot", "many", "plain", "type", "level", "page", "content", "attrs")
_WALK = r"""
    WITH RECURSIVE w(doc_id, path, up, slot, many, plain, depth, v) MAX RECURSION LEVEL 200 AS (
        SELECT doc_id, CAST(array() AS ARRAY<INT>), CAST(NULL AS ARRAY<INT>), '', false, true, 0, tree FROM {trees}
        UNION ALL
        SELECT w.doc_id, concat(w.path, array(c.pos)), CASE WHEN c.key IS NOT NULL THEN w.path ELSE w.up END, coalesce(c.key, w.slot), c.key IS NULL,
               w.plain AND coalesce(c.key, 'kids') = 'kids', w.depth + CASE WHEN c.key IS NOT NULL THEN 1 ELSE 0 END, c.value
        FROM w, LATERAL variant_explode(w.v) c WHERE schema_of_variant(c.value) RLIKE '^(ARRAY<)*(OBJECT<|VARIANT)')
    SELECT doc_id, path, up, slot, many, plain, depth,
           map_filter(transform_values(try_variant_get(v, '$', 'map<string,variant>'),
               (k, x) -> CASE WHEN schema_of_variant(x) NOT RLIKE '^(ARRAY<)*(OBJECT<|VARIANT)' THEN to_json(x) END), (k, x) -> x IS NOT NULL) AS attrs,
           regexp_count(regexp_replace(regexp_replace(to_json(v), '\\\\.', ''), '"[^"]*"', ''), '[{{]') AS size
    FROM w WHERE schema_of_variant(v) LIKE 'OBJECT<%'
"""


def _quoted(c: Column) -> Column:
    """A string as JSON text."""
    one = F.to_json(F.array(c))
    return F.when(c.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def _string(name: str) -> Column:
    """The member of that name where it is a string."""
    text = F.col("attrs")[name]
    return F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"x":'), text, F.lit("}")), "$.x"))


def _whole(name: str) -> Column:
    """The member of that name where it is a whole number."""
    text = F.col("attrs")[name]
    return F.when(text.rlike("^-?[0-9]{1,9}$"), text.cast("int"))


def walk(trees: DataFrame, key: str = "doc_id", tree: str = "tree") -> DataFrame:
    """Node rows of trees (VARIANT), by a recursive query that opens one level a step.

    Each step is one exchange of the rows of its level; what was found is written under
    ``spark.checkpoint.dir``, so that it is walked once however often it is read. A node's
    interval comes from the number of objects in its own text and a window by document. The
    session's limit on the rows of recursive queries is lifted.
    """
    spark = trees.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    found = stored(spark.sql(_WALK, trees=trees.select(F.col(key).alias("doc_id"), F.col(tree).alias("tree"))), "tree-walk")
    placed = found.withColumn("pre", F.row_number().over(Window.partitionBy("doc_id").orderBy("path")) - 1)
    above = placed.select("doc_id", F.col("path").alias("up"), F.col("pre").alias("parent"))
    return placed.join(above, ["doc_id", "up"], "left").select(
        "doc_id", "pre", (F.col("pre") + F.col("size") - 1).alias("upto"), "parent", "depth", "slot", "many", "plain",
        _string("type").alias("type"), _whole("heading level").alias("level"), _whole("page number").alias("page"), _string("content").alias("content"), "attrs",
    )


def _in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("pre")


def covering(nodes: DataFrame, marked: Column, *cols: str, name: str = "_over") -> DataFrame:
    """``nodes`` with a struct (pre, upto, cols) of the marked node that each stands in or below.

    Marked nodes must not stand below each other; then the last one before a node is the
    only one that can reach it, and one window gives it.
    """
    last = F.last(F.when(marked, F.struct("pre", "upto", *cols)), ignorenulls=True).over(_in_order())
    return nodes.withColumn(name, last).withColumn(name, F.when(F.col("pre") <= F.col(f"{name}.upto"), F.col(name)))


def below(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """All nodes at or below those asked for (doc_id, pre, upto): a range join within documents.

    The asked node's place comes as ``of``. The documents of both sides meet by key, the
    interval is tested there.
    """
    of = asked.select("doc_id", F.col("pre").alias("of"), F.col("upto").alias("_z"))
    return nodes.join(of, "doc_id").where((F.col("pre") >= F.col("of")) & (F.col("pre") <= F.col("_z"))).drop("_z")


def _joined(rows: DataFrame, *by: str) -> DataFrame:
    text = strip("content")
    part = F.collect_list(F.when(text != "", F.struct("pre", text.alias("text"))))
    return rows.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(part), lambda x: x["text"]), " ").alias("text"))


def gather_text(nodes: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, of, text): everything written at and below the nodes asked for, in reading order."""
    return _joined(below(nodes, asked), "doc_id", "of")


def text_chars(nodes: DataFrame) -> DataFrame:
    """(doc_id, chars): letters and digits in all contents of a document."""
    return nodes.groupBy("doc_id").agg(F.sum(F.coalesce(letters_and_digits("content"), F.lit(0))).cast("long").alias("chars"))


def tree_page_stats(nodes: DataFrame) -> DataFrame:
    """(doc_id, page, elements, chars) of nodes that have a type and a page, nested ones too."""
    own = nodes.where((F.col("type") != "") & F.col("page").isNotNull())
    return own.groupBy("doc_id", "page").agg(F.count("*").cast("int").alias("elements"), F.sum(F.coalesce(F.length(strip("content")), F.lit(0))).cast("int").alias("chars"))


def tree_grids(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """(doc_id, pre, grid) of tables not below each other: texts of the cells in each row."""
    marked = nodes.join(tables.select("doc_id", "pre", F.lit(True).alias("_t")), ["doc_id", "pre"], "left")
    inside = covering(marked, F.col("_t").isNotNull(), name="_table").where("_table is not null").drop("_t")
    row = covering(inside, (F.col("slot") == "rows") & (F.col("parent") == F.col("_table.pre")), name="_row").where("_row is not null")
    cell = covering(row, (F.col("slot") == "cells") & (F.col("parent") == F.col("_row.pre")), name="_cell")
    every = cell.select("doc_id", F.col("_table.pre").alias("table"), F.col("_row.pre").alias("row"), F.col("_cell.pre").alias("cell"), "pre", "content")
    texts = _joined(every, "doc_id", "table", "row", "cell")
    rows = texts.groupBy("doc_id", "table", "row").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("cell").isNotNull(), F.struct("cell", "text")))), lambda x: x["text"]).alias("cells"))
    return rows.groupBy("doc_id", F.col("table").alias("pre")).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda x: x["cells"]).alias("grid"))


def flatten_tree(nodes: DataFrame) -> DataFrame:
    """Blocks (doc_id, ord, kind, level, page, text) in reading order.

    Headings, tables and lists stand for what is below them; of a list its items' own
    texts count; all else is read down through ``kids``.
    """
    closed = F.col("plain") & F.col("type").isin("heading", "table", "list")
    before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
    seen = nodes.withColumn("_to", F.max(F.when(closed, F.col("upto"))).over(before))
    open_ = seen.withColumn("_open", F.coalesce(F.col("pre") > F.col("_to"), F.lit(True)) & F.col("plain"))
    lists = covering(open_, F.col("_open") & (F.col("type") == "list"), "page", name="_list")
    item = (F.col("_list.pre") == F.col("parent")) & (F.col("slot") == "list items")
    tables = open_.where("_open and type = 'table'").select("doc_id", "pre", "upto")
    grids = tree_grids(nodes, tables)
    own, kind = strip("content"), F.when(F.col("type") == "heading", "heading").when(F.col("type") == "table", "table").otherwise("text")
    shown = lists.where(item | (F.col("_open") & (F.coalesce(F.col("type"), F.lit("")) != "list"))).withColumn("_item", F.coalesce(item, F.lit(False)))
    kind = F.when(F.col("_item"), "text").otherwise(kind)
    text = F.when(F.col("_item"), F.when(own != "", F.concat(F.lit("- "), own))).when(kind == "table", grid_markdown("grid")).otherwise(own)
    out = shown.join(grids, ["doc_id", "pre"], "left").select(
        "doc_id", "pre", kind.alias("kind"), F.when(kind == "heading", F.greatest(F.coalesce("level", F.lit(1)), F.lit(1))).alias("level"),
        F.when(F.col("_item"), F.coalesce("page", "_list.page")).otherwise(F.col("page")).alias("page"), text.alias("text"),
    )
    out = out.where("text <> ''")
    return out.withColumn("ord", F.row_number().over(_in_order())).select("doc_id", "ord", "kind", "level", "page", "text")


def tidy_tree(nodes: DataFrame) -> DataFrame:
    """Node rows tidied, whole subtrees moved.

    Among nodes reached through ``kids``: noise headings become paragraphs; items of lists
    lose a leading bullet sign; lists that hold numbered paragraphs are cut into lists of
    the runs of other items, and paragraphs in the list's place that keep all below them
    and, if they have no page, take the list's. A list that has parts besides its items is
    not cut. What stands inside an item is moved with it but not tidied.
    """
    noise = F.col("plain") & (F.col("type") == "heading") & heading_is_noise("content")
    noise = F.coalesce(noise, F.lit(False))
    n = nodes.withColumns({"type": F.when(noise, "paragraph").otherwise(F.col("type")), "level": F.when(~noise, F.col("level"))})
    lists = n.where("plain and type = 'list'").select("doc_id", F.col("pre").alias("parent"), F.struct("pre", "parent", "depth", "slot", "page").alias("_list"))
    n = n.join(lists, ["doc_id", "parent"], "left")
    item = F.col("_list").isNotNull() & (F.col("slot") == "list items")
    n = n.withColumn("content", F.when(item, strip_list_bullet("content")).otherwise(F.col("content")))
    # numbered paragraphs among the items of each list, as list_paragraph_flags has them
    family = Window.partitionBy("doc_id", "_list.pre")
    flat = strip(F.coalesce("content", F.lit("")))
    numbered = F.when(item, flat.rlike(NUMBERED_ITEM))
    n = n.withColumn("_n", numbered).withColumn("_long", numbered & (F.length(flat) > LONG_ITEM)).withColumn("_odd", F.col("_list").isNotNull() & ~item)
    cut = F.col("_list").isNotNull() & (F.count_if("_n").over(family) >= 2) & (F.count_if("_long").over(family) >= 1) & (F.count_if("_odd").over(family) == 0)
    n = n.withColumn("_cut", cut).withColumn("_para", F.coalesce(F.col("_cut") & F.col("_n"), F.lit(False))).withColumn("_item", F.coalesce(F.col("_cut") & ~F.col("_n"), F.lit(False)))
    # runs of items: a new one after each paragraph; its list stands right before its first item
    ordered = family.orderBy("pre")
    n = n.withColumn("_run", F.count_if("_para").over(ordered))
    run = Window.partitionBy("doc_id", "_list.pre", "_run")
    first = F.min(F.when(F.col("_item"), F.col("pre"))).over(run)
    n = n.withColumn("_first", F.when(F.col("_item"), first)).withColumn("_last", F.max(F.when(F.col("_item"), F.col("upto"))).over(run)).withColumn("_count", F.count_if("_item").over(run))
    heads = n.where("_item and pre = _first").select("doc_id", F.col("_list.pre").alias("_of"), F.col("pre").alias("_at"), "_last", "_count")
    gone = n.where("_cut").select("doc_id", F.col("_list.pre").alias("pre")).distinct().withColumn("_gone", F.lit(True))
    n = covering(n, F.col("_para"), name="_moved")
    up = F.when(F.col("_para"), F.col("_list.parent")).when(F.col("_item"), F.col("_first")).otherwise(F.col("parent"))
    old = n.join(gone, ["doc_id", "pre"], "left")
    moved = old.where("_gone is null").select(
        "doc_id", "pre", F.lit(1).alias("k"), F.col("upto").alias("last"), up.alias("up"), F.when(F.col("_item"), 0).otherwise(1).alias("up_k"),
        (F.col("depth") - F.col("_moved").isNotNull().cast("int")).alias("depth"), F.when(F.col("_para"), F.col("_list.slot")).otherwise(F.col("slot")).alias("slot"), "many",
        (F.col("plain") | F.col("_para")).alias("plain"), F.when(F.col("_para"), "paragraph").otherwise(F.col("type")).alias("type"), "level",
        F.when(F.col("_para"), F.coalesce("page", "_list.page")).otherwise(F.col("page")).alias("page"), "content", "attrs",
    )
    whole = old.where("_gone").withColumnsRenamed({"pre": "_of", "_last": "_l", "_count": "_c"})
    counted = F.map_concat(F.map_filter("attrs", lambda k, v: k != "number of list items"), F.create_map(F.lit("number of list items"), F.col("_count").cast("string")))
    new = whole.join(heads, ["doc_id", "_of"]).select(
        "doc_id", F.col("_at").alias("pre"), F.lit(0).alias("k"), F.col("_last").alias("last"), F.col("parent").alias("up"), F.lit(1).alias("up_k"),
        (F.col("depth") - F.col("_moved").isNotNull().cast("int")).alias("depth"), "slot", "many", "plain", "type", "level", "page", "content", counted.alias("attrs"),
    )
    rows = moved.unionByName(new).withColumn("now", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre", "k")) - 1)
    at = rows.select("doc_id", "pre", "k", "now")
    ends = at.where("k = 1").select("doc_id", F.col("pre").alias("last"), F.col("now").alias("_upto"))
    ups = at.select("doc_id", F.col("pre").alias("up"), F.col("k").alias("up_k"), F.col("now").alias("_parent"))
    out = rows.join(ends, ["doc_id", "last"]).join(ups, ["doc_id", "up", "up_k"], "left")
    return out.drop("pre").withColumnsRenamed({"now": "pre", "_upto": "upto", "_parent": "parent"}).select(*NODE)


def tree_json(nodes: DataFrame) -> DataFrame:
    """(doc_id, tree): the JSON text of each document's nodes, members in the order of their names.

    A node opens at its place and closes after the last one below it, deeper ones first, so
    the text is what stands at these places in order, whatever the depth. Type, level, page
    and content are those of the columns.
    """
    put = {"type": _quoted(F.col("type")), "content": _quoted(F.col("content")), "page number": F.col("page").cast("string"), "heading level": F.col("level").cast("string")}
    own = F.map_filter(F.create_map(*[x for k, v in put.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    rest = F.map_filter("attrs", lambda k, v: ~F.map_contains_key(own, k) & ((k != "heading level") | F.col("level").isNotNull()))
    members = F.transform(F.array_sort(F.map_entries(F.map_concat(rest, own))), lambda e: F.concat(_quoted(e["key"]), F.lit(":"), e["value"]))
    family = Window.partitionBy("doc_id", "parent", "slot").orderBy("pre")
    n = nodes.withColumn("_m", members).withColumn("_bare", F.lag(F.size("_m") == 0).over(_in_order()))
    n = n.withColumn("_first", F.lag("pre").over(family).isNull()).withColumn("_last", F.lead("pre").over(family).isNull())
    comma = F.when((F.col("pre") == F.col("parent") + 1) & F.col("_bare"), "").otherwise(",")
    name = F.when(F.col("parent").isNull(), "").otherwise(F.concat(comma, _quoted(F.col("slot")), F.lit(":")))
    lead = F.when(~F.col("_first"), ",").otherwise(F.concat(name, F.when(F.col("many"), "[").otherwise("")))
    start = F.struct(F.col("pre").alias("at"), F.lit(0).alias("side"), F.lit(0).alias("inner"), F.concat(lead, F.lit("{"), F.array_join("_m", ",")).alias("s"))
    stop = F.struct(F.col("upto").alias("at"), F.lit(1).alias("side"), (-F.col("depth")).alias("inner"), F.when(F.col("_last") & F.col("many"), "}]").otherwise("}").alias("s"))
    pieces = F.array_sort(F.flatten(F.collect_list(F.array(start, stop))))
    return n.groupBy("doc_id").agg(F.array_join(F.transform(pieces, lambda x: x["s"]), "").alias("tree"))
