"""Files that tasks write to and read from the shared folder: temporary name first, then a rename."""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") or not re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str):
    """A stream to a temporary file that gets its own name only when all of it is written; a repeated task overwrites it with the same bytes."""
    files, path = resolve(uri)
    files.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with files.open_output_stream(draft) as out:
            yield out
        files.move(draft, path)
    except BaseException:
        if files.get_file_info(draft).type != fs.FileType.NotFound:
            files.delete_file(draft)
        raise


def opened(uri: str):
    files, path = resolve(uri)
    return files.open_input_file(path)
