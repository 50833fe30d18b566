"""Errors of the terrain operators. Argument errors are raised on the driver; a query outside a surface gives null."""

from __future__ import annotations


class TerrainError(ValueError):
    """Any refusal of a terrain operator."""


class InvalidArgument(TerrainError):
    pass


class EmptySurface(TerrainError):
    pass


class NotFound(TerrainError):
    pass


class Unsupported(TerrainError):
    pass


class LimitExceeded(TerrainError):
    pass


class StaleQuery(TerrainError):
    pass


class CorruptedData(TerrainError):
    pass
