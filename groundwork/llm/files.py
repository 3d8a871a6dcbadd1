"""Binary files in shared storage, by URI: written under a name of the attempt, then renamed, so that a
repeated task leaves one whole file."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI such as Spark gives them (file:/x and file:///x alike)."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri if re.match(r"\w+:", uri) else f"file://{uri}"))


@contextmanager
def new_file(folder: str, name: str):
    """A stream whose file appears as folder/name when the block ends well."""
    store, path = at(folder)
    store.create_dir(path, recursive=True)
    temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as out:
        try:
            yield out
        except BaseException:
            out.close()
            store.delete_file(temporary)
            raise
    store.move(temporary, f"{path}/{name}")


def open_file(folder: str, name: str):
    store, path = at(folder)
    return store.open_input_file(f"{path}/{name}")


def open_stream(folder: str, name: str):
    store, path = at(folder)
    return store.open_input_stream(f"{path}/{name}", compression=None)
