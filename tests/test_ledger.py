"""The keyed sink: broken runs, replayed batches, repeated keys, folders written together."""

import datetime as dt
from pathlib import Path

import pytest
from clipwright.sources import ledger as L
from clipwright.streaming.windows import event_stream

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, value double"
AT = dt.datetime(2024, 1, 1)


def folder(spark, tmp_path, batches):
    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame([(i, AT, 1, float(i)) for i in rows], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return event_stream(spark, path, "*.parquet", per_trigger=1)


def ids(spark, root, stream):
    return sorted(r.event_id for r in L.committed(spark, root, "q", stream.schema).collect())


@pytest.mark.parametrize("together", [0, 2])
def test_a_run_broken_before_each_commit_equals_a_clean_one(spark, tmp_path, together):
    stream = folder(spark, tmp_path, [range(0, 5), range(3, 9), [9, 9, 0], [], range(8, 12)])
    root, state = f"file://{tmp_path}/out", str(tmp_path / "state")
    broken, seen = set(), []

    def breaks(batch):
        if batch not in broken:
            broken.add(batch)
            raise RuntimeError(f"broken off in {batch}")

    def emit(batch, number):
        seen.append(number)
        raise ValueError("a listener's own fault")

    for _ in range(20):
        query = L.exactly_once(stream, root, "q", ["event_id"], state, emit, together, breaks)
        try:
            query.awaitTermination()
            break
        except Exception as problem:
            assert "broken off" in str(problem)
    assert len(broken) >= 4 and seen == sorted(broken)
    assert ids(spark, root, stream) == list(range(12))
    # What the broken runs wrote lies there and is not read.
    assert len(list(Path(tmp_path, "out", "q").glob("batch-*"))) == 2 * len(broken)
    if together:
        assert len(L.Ledger(spark, root, "q").folders()) <= together


def test_a_committed_batch_is_not_written_again(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k long, v string")
    assert L.committed(spark, root, "q", rows.schema).count() == 0
    assert L.write_once(rows, 0, root, "q", ["k"])
    assert not L.write_once(rows, 0, root, "q", ["k"])
    assert L.write_once(rows.unionByName(spark.createDataFrame([(2, "d")], rows.schema)), 1, root, "q", ["k"])
    assert sorted((r.k or 0) for r in L.committed(spark, root, "q", rows.schema).collect()) == [0, 1, 2]
    assert L.committed(spark, root, "other", rows.schema).count() == 0
    ledger = L.Ledger(spark, root, "q")
    assert ledger.batches() == {0, 1} and not ledger.commit(1, "q/late", 5) and len(ledger.folders()) == 2


def test_a_break_while_writing_together_loses_nothing(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/out"
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    commit = L.Ledger.commit

    def fails(self, batch, folder, n, whole=False):
        if whole:
            raise RuntimeError("lost")
        return commit(self, batch, folder, n, whole)

    monkeypatch.setattr(L.Ledger, "commit", fails)
    L.write_once(rows(1), 0, root, "q", ["k"], together=2)
    with pytest.raises(RuntimeError):
        L.write_once(rows(2), 1, root, "q", ["k"], together=2)
    monkeypatch.setattr(L.Ledger, "commit", commit)
    assert not L.write_once(rows(2), 1, root, "q", ["k"], together=2)
    L.write_once(rows(3), 2, root, "q", ["k"], together=2)
    L.write_once(rows(4), 3, root, "q", ["k"], together=2)
    assert len(L.Ledger(spark, root, "q").folders()) == 1
    assert sorted(r.k for r in L.committed(spark, root, "q", rows(1).schema).collect()) == [1, 2, 3, 4]
