"""Spectral analytics on Spark: a spectrum is one row with an array of intensities."""
