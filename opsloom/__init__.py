"""Spark-native operational analytics: observations, rollups, incidents, traces."""
