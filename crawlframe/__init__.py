"""crawlframe: web-crawl data processing as Spark DataFrame jobs."""
