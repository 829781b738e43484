"""Files of own formats in the shared folder, through pyarrow's file systems (local paths, file:, hdfs:, s3:, gs:).

A task writes under a name of its own attempt and reports it in its rows, so a repeated task never touches the file of an
earlier attempt, and only files named by the written index count.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def new_name(folder: str, part: int, suffix: str) -> str:
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """An output stream; the folder is made if the store has folders."""
    store, path = system(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def read(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    store, path = system(uri)
    with store.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)
