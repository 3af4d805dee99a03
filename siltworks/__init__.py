"""Siltworks: a Spark-first analytics engine for text and code corpora and the events around them."""
