"""Operators for preparing training data: thirteen methods, their queries, and the stages of ``corpus_pipeline``."""
