"""Operators over observations, spans and flows; each takes and gives DataFrames."""
