"""Stages put together from operators."""
