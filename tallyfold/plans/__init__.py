"""Whole jobs: from landed tables to stored tables and reports."""
