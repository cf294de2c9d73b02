"""Readers and writers (Parquet / JSON Lines / text) with explicit schemas."""
