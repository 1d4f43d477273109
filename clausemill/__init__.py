"""Corpus retrieval, text graphs and answer-quality scoring as Spark DataFrame operators."""
