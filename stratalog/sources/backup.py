"""Backup and restore: the pinned files, copied by the executors with a running checksum, and a manifest written last."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import SparkSession

from ..functions.checksum import crc32c
from ..model import BackupTargetError, CancelledError, CorruptedError, UnsupportedVersionError
from .commitlog import FORMAT, CommitLog, Version, _meta, _meta_back, _sealed, _unsealed
from .files import Files

MAGIC = "stratalog-backup"
BACKUP_VERSION = 1
CHUNK = 1 << 22


def _copy(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Copies each file by chunks, to a temporary name and then into place; gives its size and checksum."""
    from pyarrow import fs

    for frame in frames:
        out = []
        for source, target in zip(frame["source"], frame["target"], strict=True):
            there, path = fs.FileSystem.from_uri(source)
            here, goal = fs.FileSystem.from_uri(target)
            here.create_dir(goal.rsplit("/", 1)[0], recursive=True)
            crc = size = 0
            with there.open_input_stream(path) as a, here.open_output_stream(f"{goal}.tmp") as b:
                while chunk := a.read(CHUNK):
                    crc, size = crc32c(bytes(chunk), crc), size + len(chunk)
                    b.write(chunk)
            here.move(f"{goal}.tmp", goal)
            out.append((target, size, crc))
        yield pd.DataFrame(out, columns=["target", "size", "crc"])


def _uri(path: str) -> str:
    return path if "://" in path else "file://" + path.removeprefix("file:")


def copy_files(spark: SparkSession, pairs: list[tuple[str, str]]) -> dict[str, tuple[int, int]]:
    """Copies (source, target) pairs on the executors, a file per row; target: size and checksum."""
    if not pairs:
        return {}
    df = spark.createDataFrame([(_uri(a), _uri(b)) for a, b in pairs], "source string, target string").repartition(len(pairs))
    return {r["target"]: (r["size"], r["crc"]) for r in df.mapInPandas(_copy, "target string, size long, crc long").collect()}  # a row per file


def safe_name(path: str) -> bool:
    """Whether a path from a manifest stays inside the target."""
    parts = path.split("/")
    return bool(path) and not path.startswith("/") and "\\" not in path and ":" not in path and all(p not in ("", ".", "..") for p in parts)


def backup(store, target: str, cancelled: Callable[[], bool] = lambda: False) -> dict:
    """Copies a consistent state of the store into an empty folder; the manifest comes last, so a torn backup has none."""
    store.flush()
    out = Files(store.spark, target)
    if out.exists("BACKUP") or out.list() or out.list("_log"):
        raise BackupTargetError(f"{target} is not empty")
    with store.snapshot() as pinned:
        version: Version = pinned._at()
        done: dict[str, tuple[int, int]] = {}
        files = list(version.files)
        for at in range(0, len(files), 256):
            if cancelled():
                out.delete("")
                raise CancelledError("the backup was cancelled")
            done |= copy_files(store.spark, [(store.files.at(f.path), out.at(f.path)) for f in files[at : at + 256]])
        if cancelled():
            out.delete("")
            raise CancelledError("the backup was cancelled")
        listed = []
        for f in files:
            size, crc = done[_uri(out.at(f.path))]
            if size != f.bytes:
                raise CorruptedError(f"{f.path} changed while it was copied")
            listed.append(_meta(f) | {"crc": crc})
        manifest = {"magic": MAGIC, "backup_version": BACKUP_VERSION, "identity": store.files.read("IDENTITY").decode(), "seq": version.seq, "dead_bytes": version.dead_bytes, "files": listed}
        out.put_if_absent("BACKUP", _sealed(manifest))
    return {"seq": version.seq, "files": len(files), "bytes": sum(f.bytes for f in files)}


def restore(spark: SparkSession, source: str, target: str) -> None:
    """Makes a store of a backup. The target must not exist or be empty; a folder with a log is refused in any case."""
    src, out = Files(spark, source), Files(spark, target)
    if not src.exists("BACKUP"):
        raise CorruptedError(f"{source} has no backup manifest")
    m = _unsealed(src.read("BACKUP"), "BACKUP")
    if m.get("magic") != MAGIC:
        raise CorruptedError("not a backup")
    if m["backup_version"] > BACKUP_VERSION:
        raise UnsupportedVersionError(f"backup version {m['backup_version']}")
    if out.list("_log") or out.exists("FORMAT") or out.list():
        raise BackupTargetError(f"{target} holds a store or other files")
    files = [_meta_back(x) for x in m["files"]]
    for f in files:
        if not safe_name(f.path):
            raise CorruptedError(f"unsafe path {f.path!r} in the manifest")
        if not src.exists(f.path):
            raise CorruptedError(f"missing file {f.path}")
    done = copy_files(spark, [(src.at(f.path), out.at(f.path)) for f in files])
    for f in files:
        if done[_uri(out.at(f.path))] != (f.bytes, f.crc):
            out.delete("data")
            raise CorruptedError(f"{f.path}: size or checksum differs")
    out.put_if_absent("IDENTITY", m["identity"].encode())
    CommitLog(out).checkpoint(Version(1, m["seq"], tuple(files), (), m["dead_bytes"]))
    # the marker that makes it a store comes last
    out.put_if_absent("FORMAT", str(FORMAT).encode())
