"""Training-data operators: filters, deduplication, decontamination, mixing, token output."""
