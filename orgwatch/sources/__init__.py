"""Readers of the jobs' input files."""
