"""trawlnet: web-search analytics expressed as Spark DataFrame plans."""
