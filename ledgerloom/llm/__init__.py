"""Training-data operators: near-dedup, extraction, quality, packing, scoring and mixing."""
