"""Files of any file system that Spark can reach: selection, sharding between readers, storage operations."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import xxhash
from pyspark.sql import SparkSession

from sluice.errors import IOFlowError, ValidationError
from sluice.functions.scheduling import balanced, in_parallel, retried


@dataclass(frozen=True)
class FileInfo:
    path: str
    size: int
    modified: int = 0


@dataclass(frozen=True)
class Shard:
    """Reader `index` of `count`."""

    index: int = 0
    count: int = 1

    def __post_init__(self) -> None:
        if not 0 <= self.index < self.count:
            raise ValidationError("a shard's index is from 0 to below the count")


@dataclass(frozen=True)
class FileSelection:
    """Files under paths: recursive or not, those that pass all tests (patterns of the full path, or functions of FileInfo),
    this reader's shard of them, in an order. balanced: shards of near equal bytes, else by the path's hash."""

    paths: Sequence[str]
    recursive: bool = True
    tests: Sequence[str | Callable[[FileInfo], bool]] = ()
    shard: Shard = field(default_factory=Shard)
    balanced: bool = False
    order: Callable[[FileInfo], object] = lambda f: f.path

    def files(self, spark: SparkSession) -> list[FileInfo]:
        found = [f for p in self.paths for f in Storage(spark).list(p, self.recursive)]
        kept = sorted({f for f in found if all(self._passes(t, f) for t in self.tests)}, key=lambda f: f.path)
        if self.shard.count > 1:
            if self.balanced:
                kept = [kept[i] for i in balanced([f.size for f in kept], self.shard.count)[self.shard.index]]
            else:
                kept = [f for f in kept if xxhash.xxh64_intdigest(f.path, seed=SHARD_SEED) % self.shard.count == self.shard.index]
        return sorted(kept, key=self.order)

    @staticmethod
    def _passes(test: str | Callable[[FileInfo], bool], f: FileInfo) -> bool:
        return bool(re.fullmatch(test, f.path)) if isinstance(test, str) else test(f)


# Fixed value: the seed of path hashes, so that shards agree between readers.
SHARD_SEED = 1969


class Storage:
    """A file system by Hadoop's client: file:, hdfs:, s3a:, gs: and others whose connector is there."""

    DONE = "_DONE"

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def list(self, path: str, recursive: bool = True) -> list[FileInfo]:
        """Files under a folder, or the file itself, by path. Names that begin with _ or . are left out."""
        fs = self._fs(path)
        if not fs.exists(self._path(path)):
            raise IOFlowError(f"{path} isn't there")
        out, it = [], fs.listFiles(self._path(path), recursive)
        while it.hasNext():
            s = it.next()
            if not s.getPath().getName().startswith(("_", ".")):
                out.append(FileInfo(s.getPath().toString(), s.getLen(), s.getModificationTime()))
        return sorted(out, key=lambda f: f.path)

    def last(self, path: str, pattern: str = ".*") -> FileInfo | None:
        """The last file by path whose name fits."""
        fit = [f for f in self.list(path) if re.fullmatch(pattern, f.path.rsplit("/", 1)[-1])]
        return fit[-1] if fit else None

    def get(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put(self, path: str, data: bytes, exclusive: bool = False) -> None:
        """Writes a file; exclusive: fails if it is there."""
        if exclusive and self.exists(path):
            raise IOFlowError(f"{path} is there already")
        stream = self._fs(path).create(self._path(path), not exclusive)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()

    def delete(self, path: str) -> bool:
        return self._fs(path).delete(self._path(path), True)

    def local(self, path: str) -> str:
        """The operating system's path of a file or folder that is there; fails on other file systems than file:."""
        uri = self._fs(path).resolvePath(self._path(path)).toUri()
        if uri.getScheme() != "file":
            raise IOFlowError(f"{path} isn't in a local file system")
        return uri.getPath()

    def copy(self, source: str, target: str) -> None:
        util = self.jvm.org.apache.hadoop.fs.FileUtil
        if not util.copy(self._fs(source), self._path(source), self._fs(target), self._path(target), False, self.conf):
            raise IOFlowError(f"{source} wasn't copied")

    def move(self, source: str, target: str) -> None:
        if not self._fs(source).rename(self._path(source), self._path(target)):
            raise IOFlowError(f"{source} wasn't moved")

    def compose(self, sources: Sequence[str], target: str) -> None:
        """One file of several, in order; a part is in memory at a time."""
        stream = self._fs(target).create(self._path(target), True)
        try:
            for s in sources:
                part = self._fs(s).open(self._path(s))
                try:
                    self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, stream, self.conf, False)
                finally:
                    part.close()
        finally:
            stream.close()

    def mark_done(self, folder: str) -> None:
        self.put(f"{folder.rstrip('/')}/{self.DONE}", b"")

    def is_done(self, folder: str) -> bool:
        return self.exists(f"{folder.rstrip('/')}/{self.DONE}") or self.exists(f"{folder.rstrip('/')}/_SUCCESS")

    def lock(self, path: str) -> bool:
        """Makes a lock file; False if another has it."""
        try:
            return bool(self._fs(path).createNewFile(self._path(path)))
        except Exception:
            return False

    def retried(self, method: str, *arguments, tries: int = 4, first_wait: float = 1.0) -> object:
        """A method by name, run again after failures of the file system; what isn't there, or is already, fails at once."""
        return retried(lambda: getattr(self, method)(*arguments), tries, first_wait, terminal=lambda e: isinstance(e, IOFlowError))

    def in_parallel(self, method: str, arguments: Sequence[tuple], threads: int = 8) -> list:
        """A retried method for each tuple of arguments, several at a time: copies, moves or deletes many files."""
        return in_parallel(arguments, lambda a: self.retried(method, *a), threads)

    def identical(self, a: str, b: str) -> bool:
        """Whether two files have the same bytes."""
        infos = [self._fs(p).getFileStatus(self._path(p)) for p in (a, b)]
        if infos[0].getLen() != infos[1].getLen():
            return False
        streams = [self._fs(p).open(self._path(p)) for p in (a, b)]
        try:
            return bool(self.jvm.org.apache.commons.io.IOUtils.contentEquals(*streams))
        finally:
            for s in streams:
                s.close()

    def compress(self, source: str, target: str) -> None:
        """A file's bytes as a gz, bz2 or other file, by the target's extension; a buffer in memory at a time."""
        self._piped(source, target, None, self._codec(target))

    def decompress(self, source: str, target: str) -> None:
        self._piped(source, target, self._codec(source), None)

    def compress_folder(self, folder: str, target: str, threads: int = 8, extension: str = "gz") -> list[str]:
        """Each file of a folder compressed into another, several at a time; returns the new paths."""
        root = self._path(folder).makeQualified(self._fs(folder).getUri(), self._fs(folder).getWorkingDirectory()).toString().rstrip("/")
        pairs = [(f.path, f"{target.rstrip('/')}{f.path[len(root):]}.{extension}") for f in self.list(folder)]
        self.in_parallel("compress", pairs, threads)
        return [t for _, t in pairs]

    def _codec(self, path: str):
        codec = self.jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(self.conf).getCodec(self._path(path))
        if codec is None:
            raise ValidationError(f"no compression has the extension of {path}")
        return codec

    def _piped(self, source: str, target: str, read, write) -> None:
        raw = self._fs(source).open(self._path(source))
        stream = read.createInputStream(raw) if read else raw
        out = self._fs(target).create(self._path(target), True)
        out = write.createOutputStream(out) if write else out
        try:
            self.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, self.conf, False)
        finally:
            out.close()
            stream.close()
