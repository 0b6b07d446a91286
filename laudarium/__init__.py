"""Laudarium: analytics over edited text corpora, declared with Spark DataFrames."""
