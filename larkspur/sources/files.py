"""Paths of pyarrow's file systems, for sources that read and write files themselves."""

from __future__ import annotations

import pyarrow.fs


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it. A local path must be one that driver and executors share."""
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), path
