"""Repeated cross-sectional survey analysis as Spark jobs."""
