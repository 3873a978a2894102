"""Operators for large training-data pipelines.

One module per operator (exact top-k, token counts, mixing, embedding
near-dedup, substring dedup, byte-level BPE, toxicity, secrets, n-gram
Jaccard join, URL filter) plus shared helpers. ``catalog`` registers their
queries. Nothing outside this subpackage imports it.
"""
