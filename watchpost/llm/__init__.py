"""Training-data operators: quality rules, deduplication, token files, models and scans over document tables."""
