"""Operators for preparing training data: quality, duplicates, leaks, personal data, extraction, packing, scoring."""
