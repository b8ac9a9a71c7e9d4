"""Files of the archive sources: any store that pyarrow opens, and manifests of committed files, one a commit."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

MANIFEST = "_manifest-"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file:")


def new_name(suffix: str) -> str:
    """A name that no other attempt of a task takes."""
    return f"part-{uuid.uuid4().hex}{suffix}"


def commit(path: str, files: list[tuple[str, int]]) -> None:
    """Name the files that a successful write left; a reader sees those of all commits and no others."""
    s, top = store(path)
    s.create_dir(top, recursive=True)
    with s.open_output_stream(f"{top}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
        f.write(json.dumps(sorted(files)).encode())


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a folder: the manifests', or all with such a suffix."""
    s, top = store(path)
    own = s.get_file_info([top])[0]
    if own.type == fs.FileType.File:
        return [(top, own.size)]
    found = s.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
    named, manifests = [], [x for x in found if x.base_name.startswith(MANIFEST)]
    for info in manifests:
        with s.open_input_stream(info.path) as f:
            named += [(f"{top}/{n}", size) for n, size in json.loads(f.read())]
    if manifests:
        return sorted(named)
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.path.endswith(suffixes))


def remove(path: str, names: list[str]) -> None:
    s, top = store(path)
    for n in names:
        if s.get_file_info([f"{top}/{n}"])[0].type == fs.FileType.File:
            s.delete_file(f"{top}/{n}")
