"""Files in the shared folder, opened by executors through pyarrow's file systems (file, hdfs, s3, gs, abfs)."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """A path without a scheme is one of the file system that all machines mount alike."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


class Roller:
    """Files of about `most` bytes in a folder. Names are new for each attempt of a task, so a lost task leaves no half of a file that is read."""

    def __init__(self, folder: str, task: int, suffix: str, most: int):
        self.system, self.folder = file_system(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.uri, self.task, self.suffix, self.most, self.out = folder, task, suffix, most, None

    def append(self, data: bytes) -> tuple[str, int]:
        """The uri of the file and the place in it."""
        if self.out is None or self.at >= self.most:
            self.close()
            name = f"{self.task:06d}-{uuid.uuid4().hex}{self.suffix}"
            self.now, self.at = f"{self.uri}/{name}", 0
            self.out = self.system.open_output_stream(f"{self.folder}/{name}", compression=None)
        at = self.at
        self.out.write(data)
        self.at += len(data)
        return self.now, at

    def close(self, end: bytes = b"") -> None:
        if self.out is not None:
            if end:
                self.out.write(end)
            self.out.close()
            self.out = None


class Ranges:
    """Range reads; the file last read stays open."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            system, path = file_system(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)


def read_all(uri: str) -> bytes:
    system, path = file_system(uri)
    with system.open_input_file(path) as f:
        return f.read()


def write_file(uri: str, data: bytes) -> None:
    system, path = file_system(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)
