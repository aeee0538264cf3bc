"""Composite jobs and the mapping of the test tables to poll tables."""
