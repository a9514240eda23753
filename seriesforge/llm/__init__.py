"""Operators of a training-data pipeline. Nothing outside this subpackage imports it, but for the entry module and corpus_pipeline."""
