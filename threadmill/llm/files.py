"""Binary files in a folder that all machines share, written by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs
from pyspark import TaskContext


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder or file, given as a path or URI."""
    if uri.startswith("file:"):
        uri = "/" + uri.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


def write_new(folder: str, stem: str, ending: str, pieces: list[bytes]) -> str:
    """Write a file under a name no other attempt of this task uses; returns its name.

    A task that runs twice leaves two files.  Readers see the one that the
    table of finished tasks names."""
    system, path = located(folder)
    system.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex}{ending}"
    with system.open_output_stream(f"{path}/{name}") as out:
        for piece in pieces:
            out.write(piece)
    return name


def task_number() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0
