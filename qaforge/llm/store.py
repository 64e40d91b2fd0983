"""Files in the folder that driver and executors share: written under a passing name and then renamed, read by memory map.

A path on a mounted file system is opened directly. Any other store is reached through pyarrow's file systems; a file to be mapped is then
copied once per worker into its temporary folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from typing import BinaryIO
from urllib.parse import urlparse


def local_path(uri: str) -> str | None:
    """Path of a uri on a mounted file system, else None."""
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


@contextmanager
def writing(uri: str) -> Iterator[BinaryIO]:
    """A new file that appears under its name only when it is whole, so a repeated task replaces it by an equal one."""
    passing = f"{uri}.{uuid.uuid4().hex}.tmp"
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(local_path(passing), "wb") as f:
            yield f
        os.replace(local_path(passing), path)
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(passing)
    store.create_dir(os.path.dirname(at), recursive=True)
    with store.open_output_stream(at) as f:
        yield f
    store.move(at, fs.FileSystem.from_uri(uri)[1])


@lru_cache(maxsize=4096)
def mappable(uri: str) -> str:
    """A local path with the file's bytes."""
    path = local_path(uri)
    if path is not None:
        return path
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    copy = os.path.join(tempfile.gettempdir(), uuid.uuid4().hex)
    with store.open_input_stream(at) as source, open(copy, "wb") as f:
        while block := source.read(1 << 20):
            f.write(block)
    return copy
