"""Files of own formats in the shared folder, written and read by tasks.

The folder's URI is opened with pyarrow's file systems (local and mounted paths, HDFS, S3, GCS), so
driver and executors see the same files. A file appears under its final name only when it is complete.
"""

from __future__ import annotations

import contextlib
import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it of a folder's or file's URI."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextlib.contextmanager
def created(folder: str, name: str):
    """A binary stream to folder/name; an attempt that fails, or loses against another, leaves that file whole."""
    system, path = opened(folder)
    system.create_dir(path, recursive=True)
    draft = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    try:
        system.move(draft, f"{path}/{name}")
    except OSError:
        # Some systems don't replace a file; another attempt of the same task has put it there.
        if system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
            raise
        system.delete_file(draft)


def read_range(system: fs.FileSystem, path: str, start: int, length: int) -> bytes:
    with system.open_input_file(path) as source:
        source.seek(start)
        return source.read(length)
