"""Part of foliolens."""
