"""Readers of receiver logs and packet captures, and writers of the result tables."""
