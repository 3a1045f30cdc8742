"""Telemetry analytics on PySpark: tracks, grids, detectors and their calibration."""
