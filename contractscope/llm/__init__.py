"""Training-data operators: deduplication, search, tokenisation, extraction, filtering and packing."""
