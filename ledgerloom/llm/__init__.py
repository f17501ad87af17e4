"""Corpus preparation operators for training data, all as Spark jobs."""
