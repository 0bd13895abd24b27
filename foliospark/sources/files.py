"""Files in and out: directory scans, JSON trees, JSON lines, configuration."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.parse import SUPPORTED

# Configuration keys, their types and allowed values.
CONFIG = {
    "output.formats": (list, ("markdown", "text", "html", "json")),
    "output.rag_chunks": (bool, None),
    "output.chunk_size": (int, None),
    "output.tables": (bool, None),
    "output.qa": (bool, None),
    "output.merge": (bool, None),
    "ocr.mode": (str, ("auto", "force", "off")),
    "ocr.languages": (list, None),
    "batch.jobs": (int, None),
    "batch.skip_existing": (bool, None),
    "watch.interval": (float, None),
    "pdf.pages": (str, None),
    "pdf.password": (str, None),
}
MAGIC = (
    ("%PDF", "pdf"), ("PK\x03\x04", "zip"), ("\x1f\x8b", "gzip"), ("\x89PNG", "png"), ("\xff\xd8\xff", "jpg"), ("II*\x00", "tiff"), ("MM\x00*", "tiff"),
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def is_input(path: Column) -> Column:
    """A supported file that is neither hidden nor an office lock file."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    return extension(path).isin(*SUPPORTED) & ~name.rlike(r"^(\.|~\$)")


def scan(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """(path, ext, mtime, size[, content]) of the supported files under a folder."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(is_input(F.col("path")))
    cols = [F.col("path"), extension(F.col("path")).alias("ext"), F.col("modificationTime").cast("double").alias("mtime"), F.col("length").alias("size")]
    return found.select(*cols, *(["content"] if content else []))


def sniffed(path: Column, content: Column) -> Column:
    """Kind of a source file: by extension, else by its first bytes."""
    head = F.decode(F.substring(content, 1, 512), "ISO-8859-1")
    out = F.when(head.rlike(r"(?is)^\s*<\?xml"), "xml").when(head.rlike(r"(?is)<html|<!doctype html"), "html").when(F.contains(head, F.lit("\\documentclass")), "latex").otherwise("text")
    for mark, kind in reversed(MAGIC):
        out = F.when(F.startswith(head, F.lit(mark)), kind).otherwise(out)
    known = {"html": "html", "htm": "html", "xml": "xml", "tex": "latex", "pdf": "pdf", "zip": "zip", "gz": "gzip"}
    ext = extension(path)
    for e, kind in known.items():
        out = F.when(ext == e, kind).otherwise(out)
    return out


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """JSON lines; blank lines, ``#`` comments and half-written lines are left out."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)"))
    parsed = lines.select(F.from_json("value", schema + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.where("r._corrupt_record is null").select("r.*").drop("_corrupt_record")


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """(path, tree) of JSON structure trees, whole as VARIANT."""
    text = spark.read.option("wholetext", "true").text(path).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.try_parse_json("value").alias("tree"))


def read_tree_lines(spark: SparkSession, path: str, key: str = "doc_id", kind: str = "long") -> DataFrame:
    """(key, tree) of JSON lines that hold a key and a structure tree, the tree as VARIANT."""
    return read_jsonl(spark, path, f"{key} {kind}, tree variant")


def parse_config(text: str) -> tuple[dict, list[str]]:
    """(settings by dotted key, warnings) of a TOML configuration."""
    out, warnings = {}, []
    for section, body in tomllib.loads(text).items():
        for key, value in body.items() if isinstance(body, dict) else [("", body)]:
            name = f"{section}.{key}" if key else section
            if name not in CONFIG:
                warnings.append(f"unknown setting {name}")
                continue
            kind, allowed = CONFIG[name]
            fits = isinstance(value, kind) and not (kind is int and isinstance(value, bool)) or (kind is float and isinstance(value, int) and not isinstance(value, bool))
            if not fits:
                warnings.append(f"{name} must be {kind.__name__}")
            elif allowed and any(v not in allowed for v in (value if isinstance(value, list) else [value])):
                warnings.append(f"{name} must be one of {', '.join(allowed)}")
            else:
                out[name] = value
    return out, warnings


def parse_pages(spec: str | None) -> list[int] | None:
    """``1,3,5-7`` as page numbers; None (all pages) when it cannot be read."""
    pages: set[int] = set()
    for part in (spec or "").split(","):
        a, dash, z = part.strip().partition("-")
        try:
            low = int(a)
            pages.update(range(low, (int(z) if dash else low) + 1))
        except ValueError:
            return None
    return sorted(pages) or None


def parse_selection(spec: str, n: int) -> list[int]:
    """1-based choices among n: ``all``, lists, ranges in either direction."""
    text = spec.strip().lower().replace("，", ",")
    if text in ("all", "a", "*"):
        return list(range(1, n + 1))
    out: list[int] = []
    for part in filter(None, (p.strip() for p in text.split(","))):
        a, dash, z = part.partition("-")
        low, high = int(a), int(z) if dash else int(a)
        low, high = min(low, high), max(low, high)
        if low < 1 or high > n:
            raise ValueError(f"{part} is outside 1-{n}")
        out += [i for i in range(low, high + 1) if i not in out]
    return out


def attribute_filter(spec: str) -> Column:
    """``format=pdf|png,lang=zh`` as a condition."""
    out = F.lit(True)
    for part in filter(None, (p.strip() for p in spec.split(","))):
        name, _, values = part.partition("=")
        out = out & F.col(name.strip()).isin(*values.split("|"))
    return out


def page_filter(df: DataFrame, spec: str | None, page: str = "page") -> DataFrame:
    """Rows of the pages that a page specification names."""
    pages = parse_pages(spec)
    return df.where(F.col(page).isin(*pages)) if pages else df


def first_n(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    """The first n rows in an order that is given, so that runs agree."""
    return df.orderBy(*order).limit(n)
