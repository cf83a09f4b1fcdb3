"""Operators for large text corpora: quality, dedup, decontamination, mixing, formatting, output."""
