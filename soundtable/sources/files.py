"""Files that tasks open by themselves, for formats of which only a few parts are wanted."""

from __future__ import annotations

import re

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or plain path, and the path in it."""
    if uri.startswith("file:") or not re.match(r"[a-z][a-z0-9+.-]*:", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def opened(uri: str):
    """A file for reads at any place."""
    system, path = resolve(uri)
    return system.open_input_file(path)
