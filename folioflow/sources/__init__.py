"""Readers and writers: crawl pages, catalogs, index snapshots, stages, publishing."""
