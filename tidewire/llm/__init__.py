"""Corpus operators: classifiers, decontamination, tokenizers, near-duplicates, archives, shards, media, embeddings and packing.

Every operator takes and returns DataFrames.  ``queries`` holds the registered queries and their SQL.
"""
