"""Column expressions: text, severities, histograms, robust statistics."""
