"""Operators for preparing training text: deduplication, packing, scoring, decontamination, redaction."""
