"""Operators for preparing training corpora: scoring, near duplicates, decontamination, packing, extraction."""
