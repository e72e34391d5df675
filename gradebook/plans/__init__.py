"""Assembled reports and multi-table maintenance."""
