"""Training-data operators: text deduplication, scoring, encoding and storage."""
