"""Training-data operators: tokenisation, deduplication, scoring, search, link analysis, archives and packing."""
