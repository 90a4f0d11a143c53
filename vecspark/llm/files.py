"""Small files of a data source in shared storage, by URI or path (executors and driver)."""

from __future__ import annotations

import json

from pyarrow import fs


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def write_bytes(path: str, data: bytes) -> None:
    store, p = filesystem(path)
    store.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(p) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, p = filesystem(path)
    with store.open_input_stream(p) as f:
        return f.read()


def write_manifest(path: str, files: list[dict]) -> None:
    write_bytes(f"{path.rstrip('/')}/_manifest.json", json.dumps(files).encode())


def commit_manifest(path: str, files: list[dict], overwrite: bool) -> None:
    """List ``files`` after those of earlier writes, or in their place: then the earlier files go once they are unlisted."""
    earlier = read_manifest(path) or []
    write_manifest(path, files if overwrite else earlier + files)
    if overwrite:
        store, base = filesystem(path.rstrip("/"))
        for name in (f"{base}/{f['name']}{end}" for f in earlier for end in ("", ".idx")):
            if store.get_file_info(name).type == fs.FileType.File:
                store.delete_file(name)


def read_manifest(path: str) -> list[dict] | None:
    try:
        return json.loads(read_bytes(f"{path.rstrip('/')}/_manifest.json"))
    except FileNotFoundError:
        return None
