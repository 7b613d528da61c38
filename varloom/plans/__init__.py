"""Queries of the library over the driver's tables, and the pipelines they compose."""
