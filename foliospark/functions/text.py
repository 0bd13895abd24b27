"""Native text functions: Column in, Column out; nothing here leaves the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.edits import distance
from foliospark.functions.rowwise import by_row

# Code point ranges and patterns that results depend on.
WIDE_CLASS = r"[一-鿿　-〿]"
CJK_TOKEN = r"一-鿿㐀-䶿぀-ヿ"
CJK_SPACED = r"[一-鿿㐀-䶿぀-ヿ　-〿＀-￯]"
COMPAT_RANGES = ((0x2E80, 0x2EF3), (0x2F00, 0x2FD5), (0xF900, 0xFAFF), (0xFB00, 0xFB06), (0x2F800, 0x2FA1F))
BULLETS = "•‣▪▫●○◦⁃∙·▸▹❖"
REQUIREMENT_WORDS = ("MUST", "MUST NOT", "SHALL", "SHALL NOT", "SHOULD", "SHOULD NOT", "MAY", "REQUIRED", "RECOMMENDED", "NOT RECOMMENDED", "OPTIONAL")
FILE_NAME = r"(?i)^\S+\.(xml|pdf|html?|docx?|xlsx?|pptx?|txt|json|csv)$"
NUMBERED_ITEM = r"^\(\s*\d{1,3}\s*\)\s"
LONG_ITEM = 80
HEADING_CHARS = 60
SENTENCE_END = r"[。．！？；]|[.!?;](\s|$)"
CJK_NUMERAL = r"[〇零一二三四五六七八九十百千万\d]+"
NUMBERED_HEADINGS = (
    (rf"^第\s*{CJK_NUMERAL}\s*[編篇部]", 2),
    (rf"^第\s*{CJK_NUMERAL}\s*章", 2),
    (rf"^第\s*{CJK_NUMERAL}\s*[節节]", 3),
    (rf"^第\s*{CJK_NUMERAL}\s*[款目]", 4),
    (rf"^第\s*{CJK_NUMERAL}\s*[條条]", 4),
    (r"(?i)^(?:part|chapter|title|chapitre|kapitel|cap[ií]tulo|t[ií]tulo|titel)\s+[\divxlcm]+\b", 2),
    (r"(?i)^(?:section|sec\.|secci[óo]n|abschnitt)\s*\d", 3),
    (r"(?i)^(?:article|art\.|artikel|art[ií]culo)\s*(?:\d|premi[eè]re?\b)", 4),
    (r"^§+\s*\d", 4),
)
TEX_INNER = r"(?:[^$\n]|\n(?![ \t]*\n))"
#: Applied in this order by ``norm_text``.
NORM_STEPS = (
    ("﻿", ""),
    (rf"\$\${TEX_INNER}{{0,200}}[\\^_]{TEX_INNER}{{0,200}}\$\$", " "),
    (r"\$[^$\n]{0,60}?[\\^_][^$\n]{0,60}?\$", " "),
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(?U)</?[A-Za-z][A-Za-z0-9-]*(\s[^<>]*)?/?>", " "),
    (r"(?m)^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", " "),
    (r"(?m)^[ \t]*(?:(?:[-*+•·]|\d{1,3}[.)])[ \t]+)+", " "),
    (r"[#*_`>|]+", " "),
    (r"(?U)\s+", " "),
    (rf"(?<={CJK_SPACED}) +(?={CJK_SPACED})", ""),
)
NUMBER = r"[-−–—]?\d[\d,.'  ]*\d|[-−–—]?\d"
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:\d{4}[ -]?){3}\d{4}\b", "[CARD]"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "[IP]"),
    (r"\b\d{17}[\dXx]\b", "[ID]"),
    (r"\+?\b\d{1,3}[ -]\(?\d{2,4}\)?[ -]\d{3,4}[ -]?\d{3,4}\b", "[PHONE]"),
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that is worked out once, however often ``fn`` names it (inside lambdas too)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def squeeze(c: str | Column) -> Column:
    """Unicode white space made single and stripped."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)\s+", " "), "^ | $", "")


def strip(c: str | Column) -> Column:
    """Unicode white space taken off both ends (``trim`` takes off blanks only)."""
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def estimate_tokens(c: str | Column) -> Column:
    """Wide characters count one each, four others make one token (rounded up)."""
    c = col(c)
    wide = F.regexp_count(c, F.lit(WIDE_CLASS))
    return (wide + F.floor((F.length(c) - wide + 3) / 4)).cast("int")


@lru_cache(maxsize=1)
def compat_map() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """Compatibility characters: those that become one character, what they become, and the others."""
    one, to, many = [], [], []
    for low, high in COMPAT_RANGES:
        for c in map(chr, range(low, high + 1)):
            plain = unicodedata.normalize("NFKC", c)
            if plain != c:
                if len(plain) == 1:
                    one.append(c)
                    to.append(plain)
                else:
                    many.append((c, plain))
    return "".join(one), "".join(to), tuple(many)


def compat_residual(c: str | Column) -> Column:
    """How many compatibility characters the text holds."""
    one, _, many = compat_map()
    return F.length(c) - F.length(F.translate(col(c), one + "".join(k for k, _ in many), ""))


def normalize_compat(c: str | Column) -> Column:
    """Compatibility ideographs, radicals and ligatures made plain; all else as it is."""
    one, to, many = compat_map()
    out = F.translate(col(c), one, to)
    for k, plain in many:
        out = F.replace(out, F.lit(k), F.lit(plain))
    return out


def strip_list_bullet(c: str | Column) -> Column:
    """A leading bullet sign goes if white space and more text follow it."""
    return F.regexp_replace(col(c), rf"^[{BULLETS}]+[ \t ]+(?=[^\s ])", "")


def list_paragraph_flags(items: str | Column) -> Column:
    """For an array of list items, which are numbered paragraphs rather than items.

    Judged over the whole list: two or more numbered items, one of them long.
    """
    flat = F.transform(items, lambda x: strip(F.coalesce(x, F.lit(""))))
    marks = F.transform(flat, lambda x: F.when(x.rlike(NUMBERED_ITEM), F.length(x) > LONG_ITEM))  # null: not numbered

    def flags(marked: Column) -> Column:
        numbered = F.size(F.filter(marked, lambda m: m.isNotNull())) >= 2
        return let(numbered & F.exists(marked, lambda m: F.coalesce(m, F.lit(False))), lambda yes: F.transform(marked, lambda m: m.isNotNull() & yes))

    return let(marks, flags)


def heading_is_noise(c: str | Column) -> Column:
    """A single non-CJK sign, a requirement keyword, or a file name is no heading."""
    flat = squeeze(F.coalesce(col(c), F.lit("")))
    single = (F.length(flat) == 1) & ~flat.rlike(r"[㐀-鿿぀-ヿ가-힯]")
    return single | F.upper(flat).isin(*REQUIREMENT_WORDS) | flat.rlike(FILE_NAME)


def numbered_heading(c: str | Column) -> Column:
    """struct(level, bare) of a short numbered heading line, else null."""
    flat = squeeze(c)
    out = F.lit(None).cast("struct<level:int,bare:boolean>")
    for pattern, level in reversed(NUMBERED_HEADINGS):
        rest = F.regexp_replace(flat, pattern, "")
        bare = F.regexp_replace(rest, r"^[ .,，、\-–—:：]+", "") == ""
        got = F.when(~rest.rlike(SENTENCE_END), F.struct(F.lit(level).alias("level"), bare.alias("bare")))
        out = F.when(flat.rlike(pattern), got).otherwise(out)
    return F.when((flat != "") & (F.length(flat) <= HEADING_CHARS), out)


def norm_text(c: str | Column) -> Column:
    """Text without Markdown, HTML and TeX dress, white space single."""
    out = col(c)
    for pattern, to in NORM_STEPS:
        out = F.regexp_replace(out, pattern, to)
    return strip(out)


def norm_ws(c: str | Column) -> Column:
    """Soft hyphens out, every kind of white space single."""
    out = F.replace(col(c), F.lit("­"), F.lit(""))
    return F.regexp_replace(F.regexp_replace(out, r"(?U)[\s ​]+", " "), "^ | $", "")


def cjk_inner_spaces(c: str | Column) -> Column:
    """Blanks between CJK characters, counted line by line."""
    flat = F.regexp_replace(col(c), r"[ \t]+", " ")
    return F.regexp_count(flat, F.lit(rf"(?<={CJK_SPACED}) +(?={CJK_SPACED})"))


def cjk_ratio(c: str | Column, of_visible: bool = False) -> Column:
    """Part of CJK ideographs in all characters (or in those that are not white space)."""
    n = F.length(F.regexp_replace(col(c), r"(?U)\s", "")) if of_visible else F.length(c)
    return F.when(n > 0, F.regexp_count(col(c), F.lit(r"[一-鿿㐀-䶿]")) / n).otherwise(0.0)


def tokens(c: str | Column) -> Column:
    """CJK and kana by character, all else by word."""
    return F.regexp_extract_all(col(c), F.lit(rf"(?U)([{CJK_TOKEN}]|[^\s{CJK_TOKEN}]+)"), F.lit(1))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two texts of any length."""
    return by_row(distance, T.IntegerType())(a, b)


def token_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance between two arrays of words."""
    return by_row(distance, T.IntegerType())(a, b)


#: Numbers that are canonical as they stand.
PLAIN_NUMBER = r"^(?:0|[1-9][0-9]*)$"


def canon_number(c: str | Column) -> Column:
    """A number string in canonical form, or null: see the number rules in the README."""
    return let(col(c), lambda x: F.when(x.rlike(PLAIN_NUMBER), x).otherwise(let(F.translate(x, "０１２３４５６７８９．，－＋％", "0123456789.,-+%"), _canon)))


def _canon(tok: Column) -> Column:
    body = F.regexp_replace(F.regexp_replace(tok, r"^[+\-−–—]+", ""), r"['  ]", "")
    return let(F.regexp_replace(body, r"[.,]+$", ""), lambda b: let(_pointed(b), lambda plain: _signed(tok, b, plain)))


def _pointed(body: Column) -> Column:
    """Digits with a decimal point or none."""
    has_c, has_d = F.contains(body, F.lit(",")), F.contains(body, F.lit("."))
    last = F.regexp_extract(body, r"([.,])[^.,]*$", 1)
    drop = lambda x, s: F.replace(x, F.lit(s), F.lit(""))
    commas = F.length(body) - F.length(drop(body, ","))
    dots = F.length(body) - F.length(drop(body, "."))
    both = F.when(last == ",", F.replace(drop(body, "."), F.lit(","), F.lit("."))).otherwise(drop(body, ","))
    comma = F.when((commas > 1) | (F.length(F.substring_index(body, ",", -1)) == 3), drop(body, ",")).otherwise(F.replace(body, F.lit(","), F.lit(".")))
    dot = F.when(dots > 1, drop(body, ".")).otherwise(body)
    return F.when(has_c & has_d, both).when(has_c, comma).when(has_d, dot).otherwise(body)


def _signed(tok: Column, body: Column, plain: Column) -> Column:
    """Without zeros that say nothing, with its sign; null where it is no number."""
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    minus = tok.rlike(r"^[-−–—]")
    whole = let(F.regexp_replace(short, r"^0+(?=\d)", ""), lambda x: F.when(minus & (x != "0"), F.concat(F.lit("-"), x)).otherwise(x))
    return F.when(body.rlike(r"^\d") & plain.rlike(r"^\d+(\.\d+)?$"), whole)


def numbers(c: str | Column) -> Column:
    """Canonical numbers of a text in order."""
    return plain_numbers(norm_text(c))


def plain_numbers(p: Column) -> Column:
    """As ``numbers``, for a normalised text."""
    found = F.transform(F.regexp_extract_all(p, F.lit(f"({NUMBER})"), F.lit(1)), canon_number)
    return F.filter(found, lambda x: x.isNotNull())


def md_headings(c: str | Column) -> Column:
    """Texts of the Markdown headings."""
    found = F.regexp_extract_all(col(c), F.lit(r"(?m)^\s{0,3}(#{1,6})\s+(.+?)\s*#*\s*$"), F.lit(2))
    return F.transform(found, norm_text)


def md_tables(c: str | Column) -> Column:
    """Pipe tables of a Markdown text: array of tables of rows of cells."""
    row = r"(?U)^\s*\|.*\|\s*$"
    sep = r"(?U)^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$"
    cells = lambda x: F.transform(F.split(F.regexp_replace(strip(x), r"^\|+|\|+$", ""), r"\|"), norm_text)
    marked = F.transform(F.split(col(c), "\r\n|\r|\n"), lambda x: F.when(~x.rlike(row), F.lit("\u0000")).otherwise(x))
    kept = F.filter(marked, lambda x: ~x.rlike(sep))
    runs = F.filter(F.split(F.array_join(kept, "\n"), "(?:^|\n)\u0000(?:\n\u0000)*(?:\n|$)"), lambda x: x != "")
    return F.transform(runs, lambda t: F.transform(F.filter(F.split(t, "\n"), lambda r: r.rlike(row)), cells))


def letters_and_digits(c: str | Column) -> Column:
    """Characters that are letters or numbers."""
    return F.length(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", ""))


def human_size(n: str | Column) -> Column:
    """A byte count for people to read."""
    n = col(n)
    out = F.concat(F.format_number(n / F.lit(1 << 30), 1), F.lit(" GB"))
    for unit, size in (("MB", 1 << 30), ("KB", 1 << 20)):
        out = F.when(n < size, F.concat(F.format_number(n / F.lit(size >> 10), 1), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).otherwise(out)


def slug(c: str | Column, most: int = 60) -> Column:
    """Lower-case name of letters, digits and hyphens."""
    return F.left(F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(most))


def redact(c: str | Column) -> Column:
    """Personal data replaced by placeholders."""
    out = col(c)
    for pattern, to in REDACTIONS:
        out = F.regexp_replace(out, pattern, F.lit(to))
    return out


def clip(c: str | Column, most: int = 60_000, notice: str = "\n\n[cut]") -> Column:
    """Text cut at ``most`` characters, with a notice where it was cut."""
    return F.when(F.length(c) > most, F.concat(F.left(col(c), F.lit(most)), F.lit(notice))).otherwise(col(c))


def first_error(c: str | Column) -> Column:
    """The first ``Error:`` line of captured output."""
    return F.nullif(F.regexp_extract(col(c), r"(?m)^\s*Error:\s*(.*?)\s*$", 1), F.lit(""))


def is_structural_error(c: str | Column) -> Column:
    """Whether an error message tells of a damaged file that a repair may help."""
    return F.coalesce(col(c).rlike(r"(?i)xref|trailer|startxref|eof marker|damaged|corrupt|invalid (?:pdf|object|structure)|missing root"), F.lit(False))


def length_ratio(pred: str | Column, truth: str | Column) -> Column:
    n = F.length(norm_text(truth))
    m = F.length(norm_text(pred))
    return F.when(n > 0, m / n).when(m == 0, 0.0).otherwise(F.lit(float("inf")))


def scan_kind(chars: str | Column, pages: str | Column, least: int = 50) -> Column:
    """``scan-pdf`` below ``least`` characters a page, else ``pdf``."""
    return F.when(col(chars) / F.greatest(col(pages), F.lit(1)) < least, "scan-pdf").otherwise("pdf")


def snippet(text: str | Column, term: str | Column, before: int = 80, most: int = 240) -> Column:
    """``most`` characters of squeezed text from ``before`` characters ahead of the term."""
    flat = squeeze(text)
    start = F.greatest(F.position(col(term), F.lower(flat)) - before, F.lit(1))
    part = F.substring(flat, start, F.lit(most))
    return F.concat(F.when(start > 1, "…").otherwise(""), part, F.when(start + most <= F.length(flat), "…").otherwise(""))
