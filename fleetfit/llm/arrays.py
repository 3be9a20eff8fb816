"""Numpy arrays as files of the shared folder. Used by the driver and inside tasks."""

from __future__ import annotations

import io
import uuid

import numpy as np
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def save(path: str, array: np.ndarray) -> None:
    """Written whole under another name and then renamed, so that a repeated task does no harm."""
    system, name = place(path)
    data = io.BytesIO()
    np.save(data, array)
    system.create_dir(name.rpartition("/")[0], recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as out:
        out.write(data.getbuffer())
    system.move(own, name)


def load(path: str) -> np.ndarray:
    """The array: memory-mapped from a file system of this machine, read into memory from any other."""
    system, name = place(path)
    if isinstance(system, fs.LocalFileSystem):
        return np.load(name, mmap_mode="r")
    with system.open_input_stream(name) as source:
        return np.load(io.BytesIO(source.read()))
