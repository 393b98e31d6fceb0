"""Readers and writers. Readers take a path (file, folder or glob) and return a DataFrame."""
