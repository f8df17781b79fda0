"""Spark-native leak analytics: text segments, rule scans, masking, dedup, state merge and reports."""
