"""Training-data operators: filters, deduplication, mixing and scoring of document tables."""
