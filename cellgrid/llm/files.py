"""Byte files in the shared folder, opened on executors by their URI."""

from __future__ import annotations

from urllib.parse import urlparse


def _at(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if urlparse(uri).scheme else (fs.LocalFileSystem(), uri)


def create(uri: str):
    """A new file to write bytes to; the folders above it are made."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, buffer_size=1 << 20)


def open_read(uri: str):
    system, path = _at(uri)
    return system.open_input_file(path)


def open_stream(uri: str):
    system, path = _at(uri)
    return system.open_input_stream(path, buffer_size=1 << 20)
