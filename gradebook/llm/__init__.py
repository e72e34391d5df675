"""Operators for preparing training text: filters, duplicate removal, mixing, privacy."""
