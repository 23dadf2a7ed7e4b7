"""Spark jobs for collections of text articles: extract, ingest, rank, check, score and track."""
