"""Training-data operators: deduplication, decontamination, filtering, tokenising."""
