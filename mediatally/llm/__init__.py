"""Preparing titles, manifests and log texts of the library's records as training data."""
