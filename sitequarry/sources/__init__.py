"""Readers: a site's pages, links, logs, lists and sitemaps as DataFrames."""
