"""Readers that turn tables and log formats into observations."""
