"""Readers: fixture tables, landed pages, rule and allowlist files, the paged data source."""
