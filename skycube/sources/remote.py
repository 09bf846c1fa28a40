"""Opening files inside tasks: whatever Spark lists, read in ranges where pyarrow knows the file system."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Schemes as Hadoop writes them, and as pyarrow does.
SCHEMES = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def scheme_of(path: str) -> str:
    """The scheme of a path as Spark writes it; a bare path is a local one."""
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else "file"


def in_ranges(path: Column) -> Column:
    """Whether a task can open the path itself; others are read whole, by Spark."""
    head = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return head.isin("", *SCHEMES)


def opened(path: str):
    """A seekable stream of the file. Paths are not URL-encoded; a space or a percent sign stands for itself."""
    from pyarrow import fs

    scheme = scheme_of(path)
    rest = path[len(scheme) + 1 :] if path.startswith(f"{scheme}:") else path
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/") if rest.startswith("/") else rest)
    system, at = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest, safe='/@:')}")
    return system.open_input_file(at)


def children(folder: str) -> Iterator[tuple[str, int, bool]]:
    """(path, size, whether it is a folder) of what lies in a folder, but for names that Spark takes no notice of."""
    from os import scandir

    from pyarrow import fs

    scheme, seen = scheme_of(folder), lambda name: not (name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_"))
    rest = folder[len(scheme) + 1 :] if folder.startswith(f"{scheme}:") else folder
    if scheme == "file":
        # One by one: a folder may hold millions.
        with scandir("/" + rest.lstrip("/")) as found:
            for x in found:
                if seen(x.name):
                    yield f"{folder}/{x.name}", 0 if x.is_dir() else x.stat().st_size, x.is_dir()
        return
    system, at = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest, safe='/@:')}")
    for x in system.get_file_info(fs.FileSelector(at)):
        if seen(x.base_name):
            yield f"{folder}/{x.base_name}", x.size or 0, x.type == fs.FileType.Directory


def written(path: str, data: bytes) -> None:
    """Writes a file whole: to another name first, so that a task that is lost leaves no half file under this one."""
    from pyarrow import fs
    from pyspark import TaskContext

    scheme = scheme_of(path)
    rest = path[len(scheme) + 1 :] if path.startswith(f"{scheme}:") else path
    if scheme == "file":
        system, at = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, at = fs.FileSystem.from_uri(f"{SCHEMES[scheme]}:{quote(rest, safe='/@:')}")
    task = TaskContext.get()
    half = f"{at}.{task.taskAttemptId() if task else 0}.part"
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(half) as out:
        out.write(data)
    system.move(half, at)
