"""Kinds, schemas, options and errors of the versioned log."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import types as T

#: Kinds of log rows.
LOOKUP, INLINE, POINTER, DELETE, RANGE_DELETE = 0, 1, 2, 3, 4

MAX_SEQ = (1 << 56) - 1
#: Most levels that compaction fills; level 0 holds commits as they came.
LEVELS = 7

POINTER_TYPE = T.StructType([T.StructField("file_num", T.IntegerType()), T.StructField("row_id", T.LongType()), T.StructField("length", T.IntegerType())])
POINT_SCHEMA = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("kind", T.IntegerType(), False),
        T.StructField("value", T.BinaryType()),
        T.StructField("pointer", POINTER_TYPE),
    ]
)
RANGE_SCHEMA = T.StructType([T.StructField("start", T.BinaryType(), False), T.StructField("end", T.BinaryType(), False), T.StructField("seq", T.LongType(), False)])
VALUE_SCHEMA = T.StructType(
    [
        T.StructField("file_num", T.IntegerType(), False),
        T.StructField("row_id", T.LongType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("seq", T.LongType(), False),
        T.StructField("value", T.BinaryType()),
    ]
)


class Durability(Enum):
    """When a commit returns: SYNC after the entry is forced to disk, ASYNC and NO_SYNC once the file system has it. ASYNC entries
    are forced to disk within Options.sync_interval.

    The entry becomes visible atomically in every mode; only a crash of the machine tells the modes apart.
    """

    SYNC = "sync"
    ASYNC = "async"
    NO_SYNC = "no_sync"


class StoreError(Exception):
    """Base of all errors of this package."""


class ClosedError(StoreError):
    """The store is closed."""


class KeyTooLargeError(StoreError):
    """A key is longer than max_key_size."""


class ValueTooLargeError(StoreError):
    """A value is longer than max_value_size."""


class InvalidKeyError(StoreError):
    """A key is unusable; reason says why."""

    def __init__(self, key: bytes, reason: str):
        super().__init__(f"invalid key {key!r}: {reason}")
        self.key, self.reason = key, reason


class ConflictError(StoreError):
    """A key that the transaction read was written by a later commit."""


class TxnClosedError(StoreError):
    """The transaction was committed, rolled back or aborted."""


class ReadOnlyError(StoreError):
    """A write in a read-only transaction or store."""


class TxnTooLargeError(StoreError):
    """The transaction holds more keys or bytes than allowed."""


class SnapshotClosedError(StoreError):
    """The snapshot was released."""


class CorruptedError(StoreError):
    """Files contradict the log, or a checksum is wrong."""


class UnsupportedVersionError(StoreError):
    """The directory's format is newer than this code."""


class LockedError(StoreError):
    """Another process holds the directory."""


class EncryptionError(StoreError):
    """A key is missing, wrong, unexpected or malformed."""


class BackPressureError(StoreError):
    """Too many uncompacted commits; nothing was written."""


class BackupTargetError(StoreError):
    """The place for a backup or restore is not safe to use."""


class CancelledError(StoreError):
    """The caller cancelled the work."""


class InvalidOptionsError(StoreError):
    """Options contradict each other or their bounds."""


@dataclass
class Options:
    max_key_size: int = 64 << 10
    max_value_size: int = 16 << 20
    #: Values of so many bytes and more are stored apart; 0: never.
    value_threshold: int = 1 << 10
    durability: Durability = Durability.SYNC
    #: Buffered bytes after which a commit flushes to level 0.
    buffer_bytes: int = 64 << 20
    #: Uncompacted level-0 files at which commits are refused.
    max_level0_files: int = 64
    level0_trigger: int = 4
    level1_bytes: int = 256 << 20
    level_multiplier: int = 10
    target_file_bytes: int = 128 << 20
    txn_max_keys: int = 100_000
    txn_max_bytes: int = 32 << 20
    #: Seconds within which an ASYNC commit is forced to disk.
    sync_interval: float = 0.2
    #: Commits between two checkpoints of the log.
    checkpoint_every: int = 100
    #: Ranges of tombstones that are joined as a broadcast nested loop; more go through disjoint segments.
    broadcast_ranges: int = 64
    #: Merges what is due after a flush and after a bulk write.
    auto_compact: bool = False
    #: Commits whose writes are remembered for the validation of transactions; older ones conflict with any commit.
    remember_commits: int = 4096
    #: Seconds that a file must be old before vacuum deletes it: other processes may read or be about to publish it.
    vacuum_age: float = 0.0
    #: Scans that cached_scan keeps; the one used longest ago goes first.
    cached_scans: int = 8
    read_only: bool = False
    track_scans: bool = False
    master_key: bytes | None = field(default=None, repr=False)

    def validate(self) -> Options:
        positive = (
            "max_key_size", "max_value_size", "buffer_bytes", "max_level0_files", "level0_trigger", "level1_bytes", "target_file_bytes",
            "txn_max_keys", "txn_max_bytes", "checkpoint_every", "remember_commits", "cached_scans", "sync_interval",
        )
        for name in positive:
            if getattr(self, name) <= 0:
                raise InvalidOptionsError(f"{name} must be positive")
        if self.value_threshold < 0 or self.broadcast_ranges < 0 or self.vacuum_age < 0:
            raise InvalidOptionsError("thresholds must not be negative")
        if self.level_multiplier < 2:
            raise InvalidOptionsError("level_multiplier must be 2 at least")
        if self.level0_trigger > self.max_level0_files:
            raise InvalidOptionsError("level0_trigger must not be above max_level0_files")
        if self.master_key is not None and len(self.master_key) != 32:
            raise EncryptionError("the master key must have 32 bytes")
        # a transaction must fit in half the buffer
        self.txn_max_bytes = min(self.txn_max_bytes, self.buffer_bytes // 2)
        return self


def check_key(key: bytes, options: Options) -> None:
    if not key:
        raise InvalidKeyError(key, "empty")
    if len(key) > options.max_key_size:
        raise KeyTooLargeError(f"{len(key)} bytes; at most {options.max_key_size}")


def check_value(value: bytes, options: Options) -> None:
    if len(value) > options.max_value_size:
        raise ValueTooLargeError(f"{len(value)} bytes; at most {options.max_value_size}")
