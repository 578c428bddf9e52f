"""Standing filters, counters and deduplication on Structured Streaming."""
