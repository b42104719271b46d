"""Typed schemas of the stored tables and of the crawl log."""

from pyspark.sql import types as T

STATUSES = ["pending", "crawling", "success", "failed"]


def _struct(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


URLS = _struct(
    ("url", T.StringType(), False),
    ("source_url", T.StringType(), True),
    ("status", T.StringType(), True),
    ("depth", T.IntegerType(), True),
    ("title", T.StringType(), True),
    ("html_file_path", T.StringType(), True),
    ("created_time", T.TimestampType(), True),
    ("crawled_time", T.TimestampType(), True),
    ("error_message", T.StringType(), True),
)

PAGES = _struct(
    ("url", T.StringType(), True),
    ("content_hash", T.StringType(), True),
    ("content_size", T.IntegerType(), True),
    ("content_type", T.StringType(), True),
    ("extracted_urls_count", T.IntegerType(), True),
    ("processing_time_ms", T.IntegerType(), True),
    ("created_time", T.TimestampType(), True),
)

CRAWL_STATS = _struct(
    ("date", T.DateType(), True),
    ("urls_added", T.IntegerType(), True),
    ("urls_crawled", T.IntegerType(), True),
    ("urls_failed", T.IntegerType(), True),
    ("pages_saved", T.IntegerType(), True),
    ("total_processing_time_ms", T.LongType(), True),
    ("created_time", T.TimestampType(), True),
    ("updated_time", T.TimestampType(), True),
)

TABLES = {"urls": URLS, "pages": PAGES, "crawl_stats": CRAWL_STATS}

# One row per frontier operation; `seq` orders the rows and is unique.
CRAWL_LOG = _struct(
    ("seq", T.LongType(), False),
    ("ts", T.TimestampType(), True),
    ("url", T.StringType(), False),
    ("op", T.StringType(), False),
    ("depth", T.IntegerType(), True),
    ("source_url", T.StringType(), True),
    ("title", T.StringType(), True),
    ("html_file_path", T.StringType(), True),
    ("error_message", T.StringType(), True),
)
