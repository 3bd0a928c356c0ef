"""Scrivener: speech-transcript analytics as composable Spark DataFrame operators."""
