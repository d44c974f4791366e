"""Compositions of operators: the pipeline, the reports and the filterable queries."""
