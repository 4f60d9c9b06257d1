"""Relational operators of the engine, all written with DataFrames."""
