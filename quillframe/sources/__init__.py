"""Readers, the file admission gate and the verdict writers."""
