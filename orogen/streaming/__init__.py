"""Edits applied as a stream."""
