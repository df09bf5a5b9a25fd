"""Spark operators over text-to-SQL corpora, predictions and their errors."""
