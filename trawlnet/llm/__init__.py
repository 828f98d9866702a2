"""Operators for large-scale training-data pipelines. Nothing else in trawlnet imports this subpackage."""
