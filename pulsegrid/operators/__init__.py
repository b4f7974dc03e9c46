"""Operators over DataFrames: retrieval, metrics, dialogues, signals, ETL."""
