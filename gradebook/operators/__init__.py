"""Set-based operators over the nine tables."""
