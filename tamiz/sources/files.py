"""Files as the tasks of a job see them: listing by shares, and the file systems that Python can open."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs

_HIDDEN = (".", "_")


def local_path(uri: str) -> str | None:
    """The plain path of a local URI or path; None for other schemes."""
    scheme, colon, rest = uri.partition(":")
    if not colon or "/" in scheme:
        return uri
    return "/" + rest.lstrip("/") if scheme == "file" else None


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    path = local_path(uri)
    return (pafs.LocalFileSystem(), path) if path is not None else pafs.FileSystem.from_uri(uri)


def reachable(uri: str) -> bool:
    """Whether Python can open files there; stores that only Spark reads are left to Spark's own sources."""
    try:
        return bool(file_system(uri))
    except (ValueError, OSError, ImportError):
        return False


@dataclass(frozen=True)
class Found:
    """A file: its URI, and in milliseconds when it was last modified and when it came to its folder."""

    uri: str
    path: str
    modified: int
    arrived: int


def _mine(name: str, number: int, shares: int) -> bool:
    return zlib.crc32(os.fsencode(name)) % shares == number


def _shown(path: str) -> str:
    return "file://" + os.fsencode(path).decode("utf-8", "replace")


def _local(folder: str, suffix: str, number: int, shares: int) -> Iterator[Found]:
    if os.path.isfile(folder):
        entries = [folder] if number == 0 else []
    else:
        with os.scandir(folder) as found:
            entries = sorted(e.path for e in found if not e.name.startswith(_HIDDEN) and _mine(e.name, number, shares))
    for path in entries:
        if os.path.isdir(path):
            yield from _local(path, suffix, 0, 1)
        elif path.endswith(suffix):
            try:
                seen = os.stat(path)
            except FileNotFoundError:  # gone since the listing
                continue
            modified, changed = seen.st_mtime_ns // 1_000_000, seen.st_ctime_ns // 1_000_000
            # A file that was moved in keeps its old time of modification; its inode changed when it came.
            yield Found(_shown(os.path.abspath(path)), path, modified, max(modified, changed))


def share_of(uri: str, suffix: str, number: int, shares: int) -> Iterator[Found]:
    """The files below a folder that belong to one of so many shares, by a hash of the first part of their name there.

    Every task lists the names of the folder itself and then looks only at its own files and subfolders, so no
    process sees them all. Names that begin with a dot or an underscore are hidden, as in Spark's sources. A file may be given instead.
    """
    path = local_path(uri)
    if path is not None:
        yield from _local(path, suffix, number, shares)
        return
    store, base = pafs.FileSystem.from_uri(uri)
    scheme = uri.partition(":")[0]
    for info in store.get_file_info(pafs.FileSelector(base, recursive=True)):
        below = info.path[len(base):].lstrip("/")
        hidden = any(part.startswith(_HIDDEN) for part in below.split("/"))
        if info.type == pafs.FileType.File and below.endswith(suffix) and not hidden and _mine(below.split("/")[0], number, shares):
            at = (info.mtime_ns or 0) // 1_000_000
            yield Found(f"{scheme}://{info.path}", info.path, at, at)


def read_bytes(uri: str, path: str) -> bytes:
    """The whole content of a file that ``share_of(uri, ...)`` found."""
    if local_path(uri) is not None:
        with open(path, "rb") as f:
            return f.read()
    store, _ = pafs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()
