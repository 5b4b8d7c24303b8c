"""Operators for preparing training corpora: deduplication, packing, mixing, search, scans, rules."""
