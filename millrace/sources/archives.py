"""Lines of archives and of files that are read as one stream: tasks by members, nothing held whole."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession

#: Members of a zip go to tasks by ranges of about so many packed bytes; lines leave a task in frames of so many characters.
RANGE_BYTES = 64 << 20
FRAME_CHARS = 4 << 20


def opened(path: str) -> BinaryIO:
    """A seekable stream of bytes: of a local or mounted file, else by the file system that pyarrow has for the scheme."""
    scheme, _, rest = path.partition(":")
    if scheme == "file" or not rest:
        return open("/" + (rest or path).lstrip("/"), "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def members(path: str, file: BinaryIO, first: int, last: int) -> Iterator[tuple[str, BinaryIO]]:
    """Names and streams of the members of an archive; of a zip those at the places first to last of its directory."""
    import gzip
    import tarfile
    import zipfile

    if path.endswith(".zip"):
        with zipfile.ZipFile(file) as z:
            for info in z.infolist()[first : last + 1]:
                if not info.is_dir():
                    with z.open(info) as body:
                        yield info.filename, body
    elif path.endswith((".tar", ".tar.gz", ".tgz")):
        with tarfile.open(fileobj=file) as tar:  # read forward only: members come in their order
            for m in tar:
                if m.isfile():
                    yield m.name, tar.extractfile(m)
                tar.members = []
    elif path.endswith((".gz", ".gzip")):
        with gzip.GzipFile(fileobj=file) as body:
            yield path.rsplit("/", 1)[-1].rsplit(".", 1)[0], body
    else:
        yield path.rsplit("/", 1)[-1], file


def ranges(path: str, file: BinaryIO, range_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of places in a zip's directory, of about range_bytes each; (0, 0) for any other file."""
    import zipfile

    if not path.endswith(".zip"):
        yield 0, 0
        return
    with zipfile.ZipFile(file) as z:
        first, size, last = 0, 0, -1
        for last, info in enumerate(z.infolist()):
            size += info.compress_size
            if size >= range_bytes:
                yield first, last
                first, size = last + 1, 0
        if first <= last:
            yield first, last


def streamed(files: DataFrame, take: Callable[[str], bool], charset: str = "utf-8", plain: bool = False, range_bytes: int = RANGE_BYTES,
             opener: Callable[[str], BinaryIO] = opened, tasks: int | None = None) -> DataFrame:
    """(archive, member, line_no, value) of a table with the column path; plain: files are read as they are, also archives."""
    import io

    def planned(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                with opener(path) as file:
                    rows += [(path, a, b) for a, b in ([(0, 0)] if plain else ranges(path, file, range_bytes))]
            yield pd.DataFrame(rows, columns=["path", "first", "last"])

    def bodies(path: str, file: BinaryIO, first: int, last: int):
        return [(path.rsplit("/", 1)[-1], file)] if plain else members(path, file, first, last)

    def read(batches):
        import pandas as pd

        columns, rows, chars = ["archive", "member", "line_no", "value"], [], 0
        for pdf in batches:
            for path, first, last in zip(pdf["path"], pdf["first"], pdf["last"], strict=True):
                with opener(path) as file:
                    for name, body in bodies(path, file, first, last):
                        if not take(name):
                            continue
                        for i, line in enumerate(io.TextIOWrapper(body, charset, "replace")):
                            rows.append((path, name, i, line.removesuffix("\n")))
                            chars += len(line) + 1
                            if chars >= FRAME_CHARS:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, chars = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    parts = files.select("path").mapInPandas(planned, "path string, first long, last long")
    spread = parts.repartition(tasks or files.sparkSession.sparkContext.defaultParallelism)
    return spread.mapInPandas(read, "archive string, member string, line_no long, value string")


def archives(spark: SparkSession, path: str, member: str = "*", hidden: bool = True, ignore_suffixes: list[str] = (), charset: str = "utf-8", **how) -> DataFrame:
    """Lines of tar, tar.gz, zip and gz archives, or plain files: (archive, member, line_no, value).

    A zip is read by ranges of its members, each a task; other archives can only be read from their start, one a task. All
    are read as streams: a task holds a zip's directory, one line and one frame of lines. member: a glob on the last part of
    a member's name; hidden: whether members are read of which a part of the name begins with a dot. Invalid bytes become
    U+FFFD, a broken archive fails its task. how: range_bytes, tasks, and opener, which gives the stream of a path.
    """
    from fnmatch import fnmatch

    suffixes = tuple(ignore_suffixes)

    def take(name: str) -> bool:
        parts = name.split("/")
        return fnmatch(parts[-1], member) and not name.endswith(suffixes or ("\0",)) and (hidden or not any(p.startswith(".") and p not in (".", "..") for p in parts))

    return streamed(spark.read.format("binaryFile").load(path), take, charset, **how)


def keeps_line_feed(charset: str) -> bool:
    """Whether a charset's line feed is the byte 10, which is in no other character and leaves no state behind: then lines
    can be split before they are decoded."""
    name = codecs.lookup(charset).name
    return "\n".encode(charset) == b"\n" and not name.startswith(("utf-7", "hz", "iso2022"))
