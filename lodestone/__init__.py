"""Lodestone: typed logic programs with decisions, evaluated on Spark."""
