"""Opening files from tasks, wherever pyarrow can."""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs


def open_stream(uri: str) -> pa.NativeFile:
    """A file to read from start to end: plain paths and file: are local, others as pyarrow knows them."""
    parts = urlparse(uri)
    store, path = (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None, buffer_size=1 << 20)
