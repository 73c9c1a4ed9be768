"""Catalog search, crawl-page extraction, text cleaning and shelf state on PySpark DataFrames."""
