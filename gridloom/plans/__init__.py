"""Helpers that shape plans: durable cuts of lineage and fixed-point loops."""
