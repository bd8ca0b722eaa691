"""Files that tasks write to and read from the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, as Arrow knows it, and the path there."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


@contextlib.contextmanager
def written(path: str) -> Iterator[pa.NativeFile]:
    """A stream whose bytes appear under ``path`` when it is closed without an error.

    Attempts write under names of their own, so that one that dies or runs twice leaves no half file;
    attempts of a task write equal bytes.
    """
    system, target = place(path)
    folder, _, name = target.rpartition("/")
    system.create_dir(folder, recursive=True)
    own = f"{folder}/_attempt-{uuid.uuid4().hex}-{name}"
    with system.open_output_stream(own, compression=None) as stream:
        yield stream
    system.move(own, target)


def opened(path: str) -> pa.NativeFile:
    system, target = place(path)
    return system.open_input_file(target)


def size_of(path: str) -> int:
    system, target = place(path)
    return system.get_file_info(target).size
