"""Files in the shared folder, opened by tasks through ``pyarrow.fs`` (local, HDFS, object stores).

Every attempt of a task writes under a name of its own; which files count is
decided by the manifest rows of the attempts that Spark commits.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


def own_name(folder: str, suffix: str) -> str:
    """A file name in ``folder`` that no other attempt uses."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    """A binary output stream; its folder is made."""
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path)


def remove(uri: str):
    """Delete a folder whose files nobody reads any more."""
    system, path = _at(uri)
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def reader(uri: str):
    """A seekable binary input."""
    system, path = _at(uri)
    return system.open_input_file(path)
