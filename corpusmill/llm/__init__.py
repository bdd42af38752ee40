"""Training-data operators: quality, contamination, extraction, dedup, privacy and mixing."""
