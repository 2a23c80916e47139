"""Spark-native centroiding of profile-mode spectra."""
