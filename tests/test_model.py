"""Random operations against a dictionary of versions: get equals scan, snapshots are stable, merges change nothing."""

from __future__ import annotations

import shutil

from hypothesis import HealthCheck, settings
from hypothesis import strategies as st
from hypothesis.stateful import RuleBasedStateMachine, initialize, invariant, precondition, rule, run_state_machine_as_test

from stratalog.model import Options
from stratalog.store import Store

KEYS = st.sampled_from([bytes([c]) for c in b"abcdefgh"] + [b"a\x00", b"ab", b"\xff" * 9])


def test_store_against_a_dictionary(spark, tmp_path):
    class Machine(RuleBasedStateMachine):
        @initialize()
        def start(self):
            self.path = str(tmp_path / "db")
            shutil.rmtree(self.path, ignore_errors=True)
            self.store = Store.open(spark, self.path, Options(value_threshold=8, level0_trigger=2, checkpoint_every=5))
            self.now: dict[bytes, bytes] = {}
            self.snapshots: list = []

        @rule(key=KEYS, value=st.binary(max_size=12))
        def put(self, key, value):
            self.store.set(key, value)
            self.now[key] = value

        @rule(key=KEYS)
        def delete(self, key):
            self.store.delete(key)
            self.now.pop(key, None)

        @rule(a=KEYS, b=KEYS)
        def delete_range(self, a, b):
            self.store.delete_range(a, b)
            self.now = {k: v for k, v in self.now.items() if not a <= k < b}

        @rule(key=KEYS, a=KEYS, b=KEYS)
        def transaction(self, key, a, b):
            def both(t):
                t.delete_range(a, b)
                t.set(key, b"txn")

            self.store.update(both)
            self.now = {k: v for k, v in self.now.items() if not a <= k < b} | {key: b"txn"}

        @rule()
        def flush(self):
            self.store.flush()

        @rule()
        def compact(self):
            self.store.compact_range()

        @rule()
        def compact_due_and_vacuum(self):
            self.store.compact_now()
            self.store.vacuum()

        @precondition(lambda self: len(self.snapshots) < 2)
        @rule()
        def pin(self):
            self.snapshots.append((self.store.snapshot(), dict(self.now)))

        @precondition(lambda self: self.snapshots)
        @rule()
        def unpin(self):
            self.snapshots.pop(0)[0].close()

        @precondition(lambda self: not self.snapshots)
        @rule()
        def reopen(self):
            self.store.close()
            self.store = Store.open(spark, self.path, Options(value_threshold=8, level0_trigger=2, checkpoint_every=5))

        @rule(key=KEYS)
        def get(self, key):
            assert self.store.get(key) == self.now.get(key)

        @invariant()
        def scans(self):
            for reader, want in [(self.store, self.now), *self.snapshots]:
                assert [(bytes(r["key"]), bytes(r["value"])) for r in reader.scan().collect()] == sorted(want.items())

        def teardown(self):
            for s, _ in getattr(self, "snapshots", []):
                s.close()
            if hasattr(self, "store"):
                self.store.close()

    settings_ = settings(max_examples=4, stateful_step_count=14, deadline=None, suppress_health_check=list(HealthCheck), derandomize=True, database=None)
    run_state_machine_as_test(Machine, settings=settings_)
