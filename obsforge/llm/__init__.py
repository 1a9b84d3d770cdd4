"""Training-data operators: deduplication, filtering, formatting and packing of text corpora."""
