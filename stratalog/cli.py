"""python -m stratalog.cli DIR COMMAND ...: set KEY VALUE, get KEY (exit 3 if absent), delete KEY, scan [LOWER [UPPER]], load FILE,
flush, compact [START END], stats, fsck, vacuum, backup TARGET, restore SOURCE."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from .functions.text import human_bytes
from .model import StoreError
from .sources.backup import restore
from .sources.lines import read_lines
from .store import Store

ABSENT = 3


def main(args: list[str], spark: SparkSession | None = None, out=sys.stdout) -> int:
    if len(args) < 2:
        print(__doc__, file=sys.stderr)
        return 2
    folder, command, *rest = args
    spark = spark or SparkSession.builder.appName("stratalog").getOrCreate()
    try:
        if command == "restore":
            restore(spark, rest[0], folder)
            return 0
        with Store.open(spark, folder) as store:
            return _run(store, spark, command, rest, out)
    except (IndexError, ValueError) as e:
        print(f"{command}: {e}\n{__doc__}", file=sys.stderr)
        return 2
    except StoreError as e:
        print(f"{command}: {e}", file=sys.stderr)
        return 1


def _run(store: Store, spark: SparkSession, command: str, rest: list[str], out) -> int:
    raw = [x.encode() for x in rest]
    if command == "set":
        store.set(raw[0], raw[1])
    elif command == "get":
        value = store.get(raw[0])
        if value is None:
            return ABSENT
        print(value.decode("utf-8", "replace"), file=out)
    elif command == "delete":
        store.delete(raw[0])
    elif command == "scan":
        for r in store.scan(*raw[:2]).toLocalIterator():
            print(f"{bytes(r['key']).decode('utf-8', 'replace')} {bytes(r['value']).decode('utf-8', 'replace')}", file=out)
    elif command == "load":
        store.write(read_lines(spark, rest[0]))
    elif command == "flush":
        store.flush()
    elif command == "compact":
        print(store.compact_range(*raw[:2]) if raw else store.compact_now(), file=out)
    elif command == "stats":
        s = store.stats()
        print(f"seq {s.seq}, buffered {s.buffered_ops} ops ({human_bytes(s.buffered_bytes)})", file=out)
        for level, (n, size) in enumerate(zip(s.level_files, s.level_bytes, strict=True)):
            if n:
                print(f"level {level}: {n} files, {human_bytes(size)}", file=out)
        print(f"values apart: {s.value_files} files, {human_bytes(s.value_bytes)}, {human_bytes(s.dead_value_bytes)} dead", file=out)
    elif command == "fsck":
        wrong = store.fsck()
        print("\n".join(wrong) or "no faults", file=out)
        return bool(wrong)
    elif command == "vacuum":
        print(f"{len(store.vacuum())} files deleted", file=out)
    elif command == "backup":
        print(store.backup(rest[0]), file=out)
    else:
        raise ValueError("unknown command")
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
