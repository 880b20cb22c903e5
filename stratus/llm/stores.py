"""Files in the shared folder, whatever store it lies on."""

from __future__ import annotations

import os

import pyarrow.fs


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """(file system, path in it) of a URI or a plain path."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))
