"""Operators of a training-data pipeline: packing, mixing, search, quality, URLs, PII, WARC, line and near dedup, LM."""
