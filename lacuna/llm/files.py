"""Files that tasks write to and read from the shared folder, whatever file system its address names."""

from __future__ import annotations

import os
import uuid

import pyarrow.fs as pafs


def open_folder(address: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in address and address.startswith("file:"):
        address = "file://" + address[5:]
    if "://" not in address:
        return pafs.LocalFileSystem(), os.path.abspath(address)
    return pafs.FileSystem.from_uri(address)


def write_file(address: str, name: str, parts: list[bytes]) -> int:
    """Write under a name of its own, then rename: a task that runs twice leaves one whole file."""
    fs, folder = open_folder(address)
    fs.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}-{uuid.uuid4().hex}"
    size = 0
    with fs.open_output_stream(temporary, compression=None) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temporary, f"{folder}/{name}")
    return size


def read_file(address: str, name: str) -> bytes:
    fs, folder = open_folder(address)
    with fs.open_input_file(f"{folder}/{name}") as f:
        return f.read()
