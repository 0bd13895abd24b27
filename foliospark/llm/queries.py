"""The queries over whole tables that apply each operator with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import bpe_codec, bwt_dedup, collocations, embedding_dedup, html_extract, mixing, ngram_join, packing, periodic_runs, quality, substring, token_counts, warc
from foliospark.llm.shared import bounded_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_dedup.bwt_digest(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_digest(table(spark, sf_dir, "documents"))


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op8_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digest(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.runs_digest(table(spark, sf_dir, "documents"))


QUERIES |= {
    f.__name__: f
    for f in (
        op1_bwt_dedup, op2_embedding_dedup, op3_substring_dedup, op4_warc_round_trip, op5_token_counts,
        op6_quality_rules, op7_ngram_jaccard, op8_pattern_packing, op9_html_extract, op10_mixing,
        op11_bpe_codec, op12_collocations, op13_periodic_runs,
    )
}

ORACLES["op4_warc_round_trip"] = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
    f AS (SELECT d, max(page_id) AS first FROM p GROUP BY d)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
           CASE WHEN n >= 1000 AND page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN n >= 1000 AND page_id < first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS error
    FROM p JOIN f ON p.d = f.d
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op3_substring_dedup"] = f"""
    WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    k AS (SELECT doc_id, pos, md5(string_agg(word, ' ') OVER f) AS h, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
    first AS (SELECT h, min(doc_id) AS lo FROM k WHERE n = 50 GROUP BY h),
    g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM k JOIN first USING (h) WHERE n = 50 AND lo < doc_id),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t FROM x ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id),
    gone AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id)
    SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
    FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id
"""

ORACLES["op6_quality_rules"] = rf"""
    WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS} AS ws FROM documents),
    x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    tri AS (SELECT doc_id, pos, word || ' ' || lead(word) OVER f || ' ' || lead(word, 2) OVER f AS k FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos)),
    twice AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, k) AS n FROM tri WHERE k IS NOT NULL) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([pos, pos + 1, pos + 2]) AS p FROM twice) GROUP BY doc_id),
    line AS (SELECT doc_id, source, l, regexp_extract_all({_LOWER.format('l')}, '[^\x20\x09-\x0D]+') AS ls FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM w)),
    worded AS (SELECT doc_id, source, l, array_to_string(ls, ' ') AS k, len(ls) AS n FROM line WHERE len(ls) > 0),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM worded GROUP BY doc_id),
    host AS (SELECT source, count(DISTINCT doc_id) AS n FROM documents GROUP BY source),
    often AS (SELECT c.source, c.k FROM (SELECT source, k, count(DISTINCT doc_id) AS n FROM worded GROUP BY source, k) c JOIN host h ON h.source IS NOT DISTINCT FROM c.source WHERE c.n > 10 AND c.n > CAST(0.05 AS DOUBLE) * h.n),
    gone AS (SELECT doc_id, sum(d.n) AS n FROM worded d JOIN often o ON o.k = d.k AND o.source IS NOT DISTINCT FROM d.source GROUP BY doc_id),
    f AS (
        SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
               CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
        FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN gone ON gone.doc_id = w.doc_id),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND n_words - n_removed_words >= 50 AND n_words - n_removed_words >= CAST(0.3 AS DOUBLE) * n_words AS kept, n_removed_words
    FROM b
"""

ORACLES["op7_ngram_jaccard"] = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.replace("coalesce(text, '')", _LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
    x AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM w),
    k AS (SELECT doc_id, string_agg(word, ' ') OVER f AS k, count(*) OVER f AS n FROM x WINDOW f AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
    s AS (SELECT DISTINCT doc_id, k FROM k WHERE n = 5 UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
    size AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
    reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b),
    low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
    SELECT w.doc_id, CAST(coalesce(size.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(low.b, w.doc_id)) AS component_id
    FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN low ON low.a = w.doc_id
"""

ORACLES["op12_collocations"] = rf"""
    WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    x AS (SELECT lang, row_number() OVER () AS pid, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    w AS (SELECT lang, pid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM x),
    g AS ({" UNION ALL ".join(
        f"SELECT lang, {m} AS m, string_agg(word, ' ') OVER f AS phrase, count(*) OVER f AS held FROM w WINDOW f AS (PARTITION BY pid ORDER BY pos ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)" for m in range(1, 6))}),
    f AS (SELECT lang, m, phrase, count(*) AS a FROM g WHERE held = m GROUP BY ALL HAVING count(*) >= 100),
    n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
    c AS (SELECT lang, m, phrase, a FROM f WHERE m > 1),
    k AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS ws, unnest(range(1, m)) AS k FROM c),
    s AS (SELECT k.lang, k.phrase, k.m, k.a, x.a AS l, y.a AS r, n.n, CAST((1000::HUGEINT * k.a * n.n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score, k
        FROM k JOIN f x ON x.lang = k.lang AND x.phrase = array_to_string(ws[1:k], ' ') JOIN f y ON y.lang = k.lang AND y.phrase = array_to_string(ws[k + 1:], ' ') JOIN n ON n.lang = k.lang),
    b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    kept AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.lang = b.lang AND c.m > b.m AND 100 * c.a >= 100 * b.a AND contains(' ' || c.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000
"""
