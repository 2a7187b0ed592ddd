"""Bytes of files in stores that tasks reach by URI, for the data sources that read a range of a file a task."""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs


def listed(path: str, suffix: str) -> list[str]:
    """The files of a path: itself, those of a folder, or those that a pattern in its last part names; sorted, ending in suffix."""
    store, at = fs.FileSystem.from_uri(path)
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    if any(c in posixpath.basename(at) for c in "*?["):
        folder, pattern = posixpath.split(at)
    elif store.get_file_info(at).type == fs.FileType.Directory:
        folder, pattern = at.rstrip("/"), "*"
    elif store.get_file_info(at).type == fs.FileType.File:
        return [path]
    else:
        raise FileNotFoundError(path)
    found = [f.path for f in store.get_file_info(fs.FileSelector(folder)) if f.type == fs.FileType.File]
    return sorted(prefix + f for f in found if fnmatch.fnmatch(posixpath.basename(f), pattern) and f.lower().endswith(suffix))


def read(path: str, at: int = 0, size: int | None = None) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read_at(f.size() - at if size is None else size, at)


def ranges(n: int, parts: int) -> list[tuple[int, int]]:
    """0 to n in at most so many runs of like length."""
    parts = max(1, min(parts, n))
    cuts = [n * k // parts for k in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False)) if n else []
