"""Whole runs made of operators: simulation, quality report, refresh, publication, command line."""
