"""Thin queries over the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from automill.llm import html_extract, warc_audit
from automill.llm.scratch import keep


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def damaged_pages(pages: DataFrame) -> DataFrame:
    """The pages without some known ids, and with longer, shorter or other payloads for some others."""
    known = lambda n, k: F.coalesce(F.pmod("page_id", F.lit(n)) == k, F.lit(False))
    html = F.coalesce("html", F.lit(""))
    other = F.concat(F.when(F.startswith(html, F.lit("~")), "!").otherwise("~"), F.substr(html, F.lit(2)))
    worse = F.when(known(3, 0) | (html == ""), F.concat(html, F.lit("damaged"))).when(known(3, 1), F.substr(html, F.lit(2))).otherwise(other)
    return pages.where(~known(211, 7)).withColumn("html", F.when(known(97, 13), worse).otherwise(F.col("html")))


def op4_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as archives, against a replica in which records with known ids are damaged or lost.

    The replica's records are made from its own payloads, and laid out and hashed on their own.
    """
    pages = _pages(spark, sf_dir)
    records = keep(warc_audit.archive_pages(pages), "warc-records")
    replica = keep(warc_audit.aligned(warc_audit.archive_pages(damaged_pages(pages)), records), "warc-replica")
    return warc_audit.audit(records, replica)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = html_extract.extract(_pages(spark, sf_dir))
    return out.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op4_warc_fixity, op10_html_extraction)}

_OP4 = """
WITH r AS (
  SELECT page_id, floor(page_id / 256)::BIGINT AS archive,
         strlen(concat('WARC/1.1', chr(13), chr(10), 'WARC-Type: response', chr(13), chr(10), 'WARC-Record-ID: <urn:page:', page_id, '>', chr(13), chr(10),
                       'WARC-Target-URI: ', url, chr(13), chr(10), 'Content-Type: text/html', chr(13), chr(10),
                       'Content-Length: ', strlen(coalesce(html, '')), chr(13), chr(10), chr(13), chr(10), html,
                       chr(13), chr(10), chr(13), chr(10))) AS length
  FROM pages
), o AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM r
)
SELECT archive, pos AS "offset", CASE WHEN page_id % 211 = 7 THEN 'missing' ELSE 'changed' END AS status
FROM o WHERE page_id % 211 = 7 OR page_id % 97 = 13
"""

ORACLES = {"op4_warc_fixity": _OP4}
