"""Training-data operators: mixing, vector search, toxicity, quality, near duplicates, token counts, BPE,
language identification, WARC derivatives and media columns.

Nothing outside this subpackage imports it.
"""
