"""Longitudinal censuses of document collections as Spark jobs."""
