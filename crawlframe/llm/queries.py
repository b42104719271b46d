"""Imports every module that registers a query of this subpackage."""

from crawlframe.llm import (  # noqa: F401
    centroids, chat, kd_shards, line_rules, mixing, packing, postings, ppm, secret_scan, simhash, suffix_dedup, toxicity, whitening,
)
from crawlframe.llm.common import CHECKS, QUERIES  # noqa: F401
