"""Binary files in the shared folder: written whole by executors, under names that a repeated task writes again."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    where, path = _resolve(uri)
    where.create_dir(path, recursive=True)


def write_file(uri: str, parts) -> None:
    """Write the byte strings of parts to uri: first beside it, then moved there, so no reader sees half a file."""
    where, path = _resolve(uri)
    folder, _, name = path.rpartition("/")
    part = f"{folder}/_{name}.{uuid.uuid4().hex}"
    with where.open_output_stream(part, compression=None) as f:
        for x in parts:
            f.write(x)
    where.move(part, path)


def read_file(uri: str) -> bytes | None:
    """The bytes of a file, None if there is none."""
    where, path = _resolve(uri)
    if where.get_file_info(path).type == fs.FileType.NotFound:
        return None
    with where.open_input_stream(path, compression=None) as f:
        return f.readall()
