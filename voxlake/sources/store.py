"""Files of a shared store by name or address, opened on the driver or in a task."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there. Addresses such as hdfs:// and s3:// name their store; file: and plain
    paths are read under that name on every machine."""
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), posixpath.abspath("/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path)
    return fs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """Address and size of the file, or of each file in the folder, in the order of names; hidden ones are left out."""
    store, inner = located(path)
    if store.get_file_info(inner).type == fs.FileType.File:
        return [(path, store.get_file_info(inner).size)]
    found = store.get_file_info(fs.FileSelector(inner))
    return sorted((posixpath.join(path, f.base_name), f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


def zipped(path: str) -> bool:
    store, inner = located(path)
    with store.open_input_file(inner) as f:
        return f.read(2) == b"\x1f\x8b"


def stream(path: str, unzip: bool):
    """The file's bytes from the start on, unpacked on the way where asked for."""
    store, inner = located(path)
    return store.open_input_stream(inner, compression="gzip" if unzip else None)


def seekable(path: str):
    store, inner = located(path)
    return store.open_input_file(inner)


def replaced(path: str, content: bytes, part: str) -> None:
    """The file with this content: written under the name `part` and moved when whole."""
    store, inner = located(path)
    _, beside = located(part)
    store.create_dir(posixpath.dirname(inner), recursive=True)
    with store.open_output_stream(beside, compression=None) as f:
        f.write(content)
    store.move(beside, inner)
