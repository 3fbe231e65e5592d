"""Training-data operators: packing, scans, scoring, deduplication, mixing and search."""
