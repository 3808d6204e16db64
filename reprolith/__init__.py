"""Repeatability analytics on Spark."""
