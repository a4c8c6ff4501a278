"""Core subpackage of corpusloom."""
