"""Part of the layered memory engine."""
