"""Files that tasks write to and read from the shared folder (any store Arrow can open).

A task writes under a name of its own attempt and reports it in its result rows. Those
rows are written as a table before anything reads the files, so only files of attempts
that Spark committed are ever looked at, whatever retries or lost executors did.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def new_file(root: str, label: str, suffix: str):
    """(uri, open output stream) of a fresh file below ``root``."""
    store, base = fs.FileSystem.from_uri(root)
    store.create_dir(base, recursive=True)
    name = f"{label}-{uuid.uuid4().hex}{suffix}"
    return f"{root}/{name}", store.open_output_stream(f"{base}/{name}", compression=None)


def open_stream(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def open_random(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)


def remove_file(uri: str) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.delete_file(path)
