"""Spoken-text matching and alignment analytics on Spark."""
