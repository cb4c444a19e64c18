"""Caches over streams of accesses."""
