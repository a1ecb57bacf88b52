"""ZIP archives as a Spark source: one partition per member, checked while it streams."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .ledger import ContractError

#: Bytes that a task reads of a member at a time.
CHUNK = 1 << 20


def _opened(path: str):
    """A seekable file of a local path or a URI that ``pyarrow`` knows."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        files, at = fs.FileSystem.from_uri(path)
    else:
        files, at = fs.LocalFileSystem(), path
    return files.open_input_file(at)


def checked_name(name: str) -> str:
    """A member's name; ``ContractError`` if it would leave the folder it is unpacked to."""
    parts = name.replace("\\", "/").split("/")
    if name.startswith(("/", "\\")) or ".." in parts or (len(name) > 1 and name[1] == ":") or "\0" in name:
        raise ContractError(f"member outside the folder: {name!r}")
    return name


@dataclass
class Member(InputPartition):
    path: str
    name: str
    sha256: str | None

    def __init__(self, path: str, name: str, sha256: str | None):
        super().__init__((path, name))
        self.path, self.name, self.sha256 = path, name, sha256


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = json.loads(options["paths"])
        self.digests = json.loads(options.get("digests", "{}"))
        self.suffix = options.get("suffix", "")

    def partitions(self) -> list[Member]:
        """A partition per member: only the archives' directories are read."""
        found = []
        for path in self.paths:
            with _opened(path) as f, zipfile.ZipFile(f) as z:
                names = [checked_name(i.filename) for i in z.infolist() if not i.is_dir()]
            if len(names) != len(set(names)):
                raise ContractError(f"{path}: repeated members")
            found += [Member(path, n, self.digests.get(n)) for n in names if n.endswith(self.suffix)]
        missing = set(self.digests) - {m.name for m in found}
        if missing:
            raise ContractError(f"members not in the archives: {sorted(missing)[:3]}")
        return found or [Member("", "", None)]

    def read(self, member: Member) -> Iterator[tuple]:
        """Lines of a member; its digest is compared when the last one has been read."""
        if not member.path:
            return
        seen = hashlib.sha256()

        class Hashed(io.RawIOBase):
            def __init__(self, inner):
                self.inner = inner

            def readable(self) -> bool:
                return True

            def readinto(self, buffer) -> int:
                data = self.inner.read(len(buffer))
                seen.update(data)
                buffer[: len(data)] = data
                return len(data)

        with _opened(member.path) as f, zipfile.ZipFile(f) as z, z.open(member.name) as inner:
            for number, line in enumerate(io.BufferedReader(Hashed(inner), CHUNK), 1):
                yield member.name, number, line.rstrip(b"\r\n").decode()
        if member.sha256 and seen.hexdigest() != member.sha256:
            raise ContractError(f"{member.name}: digest {seen.hexdigest()} instead of {member.sha256}")


class ZipLines(DataSource):
    """Lines of the members of ZIP archives: ``(member, line, value)``."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return "member string, line long, value string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def read_archive(spark: SparkSession, paths: list[str], digests: dict[str, str] | None = None, suffix: str = "") -> DataFrame:
    """``(member, line, value)`` of members that end in ``suffix``.

    ``digests`` (member to SHA-256) must name members that exist; one that
    differs fails the job that reads it to its end.  Names that lead out of a
    folder are refused before anything is read.  A member is one task, as ZIP
    members can be read from their start only.
    """
    spark.dataSource.register(ZipLines)
    options = {"paths": json.dumps(paths), "digests": json.dumps(digests or {}), "suffix": suffix}
    return spark.read.format("zip_lines").options(**options).load()


def read_archived_json(spark: SparkSession, paths: list[str], schema: str, digests: dict[str, str] | None = None) -> DataFrame:
    """The JSON lines of all ``.jsonl`` members as rows with ``member``; a line that is no object fails."""
    lines = read_archive(spark, paths, digests, ".jsonl").where("trim(value) <> ''")
    return lines.select("member", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("member", "r.*")
