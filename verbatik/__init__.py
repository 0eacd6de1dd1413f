"""Spark-native analytics over text tables: rewriting, tokenising, lexicon resolution and arrays."""
