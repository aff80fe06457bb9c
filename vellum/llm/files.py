"""Files that Python workers write to and read from the shared folder, in any store that pyarrow knows."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


@contextmanager
def committed(path: str):
    """A new file that gets its name only when complete; a second attempt at the same file replaces it."""
    where, name = store(path)
    folder, _, base = name.rpartition("/")
    where.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{base}.{uuid.uuid4().hex}.tmp"
    try:
        with where.open_output_stream(temporary) as out:
            yield out
        where.move(temporary, name)
    except BaseException:
        with where.open_output_stream(temporary):
            pass
        where.delete_file(temporary)
        raise


@contextmanager
def opened(path: str):
    """A file to be read in pieces, as it is."""
    where, name = store(path)
    with where.open_input_stream(name, compression=None) as f:
        yield f


def read(path: str) -> bytes:
    where, name = store(path)
    with where.open_input_stream(name) as f:
        return f.read()
