"""Dirty-data profiling, scaling and error injection, expressed as Spark plans."""
