"""The given tables as sequence records, for Spark and, as SQL text, for the oracle. Whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from bioloom.functions.residues import AMINO
from bioloom.session import spread, table

LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The run whose sequences serve as reference; all other runs count as generated.
REFERENCE_RUN = "src0"

DOCS_SQL = "docs AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
RAW_SQL = f"raw_seqs AS (SELECT doc_id, source, regexp_replace(translate(text, '{LOWER}', '{UPPER}'), '[^A-Z]', '', 'g') AS seq FROM documents)"
SEQS_SQL = f"seqs AS (SELECT doc_id, source, lang, regexp_replace(translate(text, '{LOWER}', '{UPPER}'), '[^{AMINO}]', '', 'g') AS seq FROM documents)"
#: Short sequences for pairwise work: one for each page, of run = the host's last two labels.
SHORT_SQL = f"short AS (SELECT page_id, regexp_extract(url, '://[^/]*?([a-z]+[.][a-z]+)/', 1) AS run, regexp_replace(translate(url, '{LOWER}', '{UPPER}'), '[^{AMINO}]', '', 'g') AS seq FROM pages)"
SHORT_REFERENCE = "example.net"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return spread(table(spark, sf_dir, "documents"), "doc_id").join(labels, "doc_id", "left")


def _upper(column: str):
    return F.translate(column, LOWER, UPPER)


def raw_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id")
    return rows.select("doc_id", "source", F.regexp_replace(_upper("text"), "[^A-Z]", "").alias("seq"))


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), "doc_id")
    return rows.select("doc_id", "source", "lang", F.regexp_replace(_upper("text"), f"[^{AMINO}]", "").alias("seq"))


def short(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = F.regexp_extract("url", r"://[^/]*?([a-z]+[.][a-z]+)/", 1)
    return table(spark, sf_dir, "pages").select("page_id", run.alias("run"), F.regexp_replace(_upper("url"), f"[^{AMINO}]", "").alias("seq"))


def with_views(*views: str) -> str:
    return "WITH " + ", ".join(views)


def split_sql(comps: str) -> str:
    """``parts(component, size, split)`` of a table of components: the first totals' lists of places, and the least of those nearest half."""
    return f"""z AS (SELECT component, count(*) AS size FROM {comps} GROUP BY component),
 bef AS (SELECT *, coalesce(sum(size) OVER (ORDER BY size DESC, component ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM z),
 tr AS (SELECT component, size, before < (SELECT round_even(sum(size) * 0.7, 0) FROM z) AS train FROM bef),
 h AS (SELECT component, size, row_number() OVER (ORDER BY size DESC, component) AS i FROM tr WHERE NOT train),
 t AS (SELECT 0::BIGINT AS i, 0::BIGINT AS total UNION SELECT h.i, t.total + h.size * k FROM t JOIN h ON h.i = t.i + 1 CROSS JOIN (VALUES (0), (1)) AS v(k)),
 f AS (SELECT total, min(i) AS i FROM t WHERE total > 0 AND total < (SELECT sum(size) FROM h) GROUP BY total),
 near AS (SELECT total FROM f WHERE abs(2 * total - (SELECT sum(size) FROM h)) = (SELECT min(abs(2 * total - (SELECT sum(size) FROM h))) FROM f)),
 made AS (SELECT total AS goal, total AS rest, []::BIGINT[] AS places FROM near UNION ALL SELECT goal, rest - h.size, list_prepend(h.i, places) FROM made JOIN f ON f.total = made.rest JOIN h ON h.i = f.i WHERE rest > 0),
 chosen AS (SELECT places FROM made WHERE rest = 0 ORDER BY places LIMIT 1),
 parts AS (SELECT tr.component, tr.size, CASE WHEN train THEN 'train' WHEN list_contains((SELECT places FROM chosen), h.i) THEN 'valid' ELSE 'test' END AS split FROM tr LEFT JOIN h ON h.component = tr.component)"""
