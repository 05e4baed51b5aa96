"""Files in the store that all executors reach: local or shared folders, hdfs, s3, gs and abfs addresses."""

from __future__ import annotations

from pyarrow import fs


def at(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path there."""
    scheme, colon, rest = path.partition("://")
    if not colon:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri("s3://" + rest if scheme in ("s3a", "s3n") else path)


def children(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's direct files, by path; addresses keep their scheme."""
    system, p = at(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    names = [(i.base_name, i.size) for i in system.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.File]
    return [(f"{path.rstrip('/')}/{n}", size) for n, size in sorted(names)]


def exists(path: str) -> bool:
    system, p = at(path)
    return system.get_file_info(p).type != fs.FileType.NotFound


def reading(path: str):
    """An open file that seeks; readers leave what they don't need in the store."""
    system, p = at(path)
    return system.open_input_file(p)


def writing(path: str):
    system, p = at(path)
    system.create_dir(p.rpartition("/")[0] or ".", recursive=True)
    return system.open_output_stream(p)


def remove(path: str) -> None:
    system, p = at(path)
    if system.get_file_info(p).type == fs.FileType.File:
        system.delete_file(p)


def publish(part: str, path: str, overwrite: bool = True) -> None:
    """A written sibling becomes the file, whole; without ``overwrite`` an existing one is an error and stays."""
    system, p = at(path)
    if not overwrite:
        if isinstance(system, fs.LocalFileSystem):
            import os

            os.link(at(part)[1], p)  # fails if another writer was first
            os.unlink(at(part)[1])
            return
        if exists(path):
            raise FileExistsError(path)
    system.move(at(part)[1], p)
