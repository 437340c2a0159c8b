"""Forecast candidates."""
