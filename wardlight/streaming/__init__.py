"""Structured Streaming jobs. The reference point is event time: late rows are accepted for one day."""
