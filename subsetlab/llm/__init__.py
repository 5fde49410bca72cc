"""Training-data operators: packing, token files, BPE, deduplication, filters and search."""
