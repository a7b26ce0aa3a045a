"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

from ..sources.saved import discard, discarded, shared_folder
from ..sources.saved import saved as scratch

__all__ = ["discard", "discarded", "scratch", "shared_folder"]
