"""Spark operators that turn ordered document corpora into a numbered task matrix."""
