"""Raw files in the shared folder, read and written from tasks and driver."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI that Spark uses too (local, s3, gs, abfs, hdfs)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def make_folder(uri: str) -> None:
    store, path = place_of(uri)
    store.create_dir(path, recursive=True)


@contextmanager
def new_file(uri: str) -> Iterator:
    """A file that appears under its name only when it is whole; a second attempt replaces it by the same bytes."""
    store, path = place_of(uri)
    draft = f"{path}.{uuid.uuid4().hex}"
    try:
        with store.open_output_stream(draft) as out:
            yield out
    except BaseException:
        store.delete_file(draft)
        raise
    try:
        store.move(draft, path)
    except OSError:  # some stores don't replace: another attempt was first
        if store.get_file_info(path).type != fs.FileType.File:
            raise
        store.delete_file(draft)


def open_file(uri: str):
    store, path = place_of(uri)
    return store.open_input_file(path)
