"""Kerbline: street-space analytics as Spark DataFrames."""
