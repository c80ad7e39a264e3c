"""Training-data operators: scoring, deduplication, filtering and packing of text corpora.

Nothing outside this subpackage imports it; ``queries`` lists what it registers.
"""
