"""Spark jobs over betting-exchange order books."""
