"""Readers that turn files and exports into catalog rows, and table writers."""
