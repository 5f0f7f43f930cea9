"""Robust stacking and screening of repeated observations, as Spark jobs."""
