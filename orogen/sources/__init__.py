"""Readers and writers of terrain formats."""
