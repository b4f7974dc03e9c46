"""Streaming operators: the anomaly gate and the content gate."""
