"""Files of our own formats, written and read by tasks at any place that pyarrow can open."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path on it: plain paths and file: are local, others as pyarrow knows them."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def own_name(uri: str) -> str:
    """The name with a mark of this attempt in it.

    A task run twice writes two files, and the table of files, made of the rows
    of the attempt that counts, names one; the other goes with its folder.
    """
    stem, dot, ending = uri.rpartition("/")[2].partition(".")
    return f"{uri.rpartition('/')[0]}/{stem}-{uuid.uuid4().hex[:12]}{dot}{ending}"


@contextmanager
def new_file(uri: str) -> Iterator[pa.NativeFile]:
    """A file to write; it is removed if writing fails."""
    store, path = place(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    try:
        with store.open_output_stream(path, compression=None) as out:
            yield out
    except BaseException:
        with suppress(OSError):
            store.delete_file(path)
        raise


def reader(uri: str) -> pa.NativeFile:
    store, path = place(uri)
    return store.open_input_file(path)
