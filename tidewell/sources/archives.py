"""ZIP archives on any store that Arrow's file systems know."""

from __future__ import annotations

import zipfile

import pyarrow.fs as pafs


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path there; a path without a scheme is local."""
    return pafs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (pafs.LocalFileSystem(), path)


def write_archive(path: str, members: dict[str, str]) -> None:
    """An archive of texts. It is written under a hidden name first, so that a task that runs again leaves one whole archive."""
    store, at = store_of(path)
    folder, _, name = at.rpartition("/")
    store.create_dir(folder)
    with store.open_output_stream(f"{folder}/.{name}") as raw, zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as archive:
        for member, text in members.items():
            archive.writestr(member, text)
    store.move(f"{folder}/.{name}", at)
