"""Readers and writers of notifications, series tables and telemetry."""
