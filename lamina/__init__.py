"""Layered memory analytics on Spark."""
