"""Readers: log text, Parquet tables, small local tables, saved models."""
