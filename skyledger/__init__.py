"""Skyledger: Spark jobs for market captures, station weather and forecast tables."""
