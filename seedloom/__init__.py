"""Spark jobs for microRNA-target interaction tables."""
