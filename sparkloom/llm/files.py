"""Files that tasks write into the shared folder, through the file system its address names."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def shared(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a full address. One without a scheme would mean another place here than to Spark."""
    if "://" not in uri and not uri.startswith("file:/"):
        raise ValueError(f"{uri}: give the address with its scheme, as scratch.new_path does")
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """A new file, seen under its name only when whole. The name is new at each attempt, so a task that
    runs again never touches what an earlier attempt wrote; the manifest names the attempt that counts."""
    store, path = shared(folder)
    store.create_dir(path, recursive=True)
    name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    with store.open_output_stream(f"{path}/.{name}", compression=None) as out:
        yield name, out
    store.move(f"{path}/.{name}", f"{path}/{name}")
