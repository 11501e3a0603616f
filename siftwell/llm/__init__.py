"""Training-data operators: packing, scoring, filtering, deduplication and mixing."""
