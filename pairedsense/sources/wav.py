"""A data source of WAV headers that reads ranges: 12 bytes, then the head of each chunk up to the data.

    spark.dataSource.register(WavHeaders)
    spark.read.format("wav_headers").load("/recordings/*/*.wav")

A partition is a list of files; a task opens each and jumps from chunk to chunk, so a
night of audio costs a few small reads, whatever its size. Paths may be local or of any
store that pyarrow opens by its URI.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import translate

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, length long, channels long, sample_rate long, bits long, data_bytes long"
FILES_PER_TASK = 256
UNKNOWN = 0xFFFFFFFF  # the size field of a chunk whose true size stands in a ds64 chunk


def open_store(path: str) -> tuple[fs.FileSystem, str, str]:
    """(store, path inside it, what to put before a path of the store to name it)."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        store, inside = fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
        return store, inside, path[: path.index(":") + 1] + ("//" if "://" in path else "")
    return fs.LocalFileSystem(), path, ""


def _pattern(glob: str) -> re.Pattern:
    """A glob over whole paths: ``*`` stays inside a folder, ``**`` doesn't."""
    *folders, name = [p if p == "**" else translate(p).removeprefix("(?s:").removesuffix(r")\z").removesuffix(r")\Z").replace(".*", "[^/]*") for p in glob.split("/")]
    return re.compile("".join("(?:.*/)?" if p == "**" else p + "/" for p in folders) + (".*" if name == "**" else name), re.S)


def list_files(glob: str) -> list[tuple[str, int]]:
    """(path, length) of the files that a glob names, ordered by path; a folder stands for the files in it."""
    root = re.match(r"[^*?\[]*", glob)[0]
    wild = root != glob
    store, base, scheme = open_store(root.rsplit("/", 1)[0] + "/" if wild else glob)
    if wild:
        match = _pattern(base.rstrip("/") + "/" + glob[len(root.rsplit("/", 1)[0]) + 1 :]).fullmatch
    else:
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            return [(scheme + info.path, info.size)]
        match = re.compile(re.escape(base.rstrip("/")) + "/[^/]+").fullmatch
    deep = wild and ("/" in glob[len(root) :] or "**" in glob)
    found = store.get_file_info(fs.FileSelector(base.rstrip("/") or "/", recursive=deep, allow_not_found=False))
    return sorted((scheme + i.path, i.size) for i in found if i.type == fs.FileType.File and match(i.path))


def read_header(file: pa.NativeFile, length: int) -> dict[str, int | None]:
    """Fields of the fmt chunk and the size of the data chunk; None where the file has none."""
    found: dict[str, int | None] = dict.fromkeys(("channels", "sample_rate", "bits", "data_bytes"))
    head = file.read(12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return found
    at, long_data = 12, None
    while at + 8 <= length:
        file.seek(at)
        head = file.read(8)
        name, held = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"ds64":
            long_data = int.from_bytes(file.read(24)[8:16], "little")
        elif name == b"fmt " and held >= 16:
            body = file.read(16)
            if len(body) < 16:
                break
            found |= {"channels": int.from_bytes(body[2:4], "little"), "sample_rate": int.from_bytes(body[4:8], "little"), "bits": int.from_bytes(body[14:16], "little")}
        elif name == b"data":
            found["data_bytes"] = long_data if held == UNKNOWN and long_data is not None else held
            break
        at += 8 + held + held % 2
    return found


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]


class WavReader(DataSourceReader):
    def __init__(self, path: str, per_task: int):
        self.path, self.per_task = path, per_task

    def partitions(self) -> list[InputPartition]:
        files = list_files(self.path)
        return [Files(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.files:
            store, inside, _ = open_store(path)
            with store.open_input_file(inside) as file:
                yield path, length, *read_header(file, length).values()


class WavHeaders(DataSource):
    """Options: path (a file, a folder or a glob) and filesPerTask."""

    @classmethod
    def name(cls) -> str:
        return "wav_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WavReader:
        return WavReader(self.options["path"], int(self.options.get("filespertask", FILES_PER_TASK)))
