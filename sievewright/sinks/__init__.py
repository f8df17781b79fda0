"""Reports, metrics and alert payloads."""
