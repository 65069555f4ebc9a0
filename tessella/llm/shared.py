"""The folder that driver and executors share."""

from __future__ import annotations

from tessella.storage import cut, files, folder, fresh, remove, swept

__all__ = ["cut", "files", "folder", "fresh", "remove", "swept"]
