import pytest

from barline.operators import buckets
from barline.operators.buckets import BucketedTable

SCHEMA = "code string, day int, close double"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def table(spark, tmp_path, n=16):
    return BucketedTable(spark, str(tmp_path / "t"), frame(spark, []).schema, ["code", "day"], n)


def rows_of(t):
    return {(r["code"], r["day"]): r["close"] for r in t.read().collect()}


def files_of(t):
    """Files that count, by bucket."""
    out = {}
    for path in t.read().inputFiles():
        out.setdefault(int(path.split("__bucket=")[1].split("/")[0]), set()).add(path)
    return out


def test_changes_touch_only_their_buckets(spark, tmp_path):
    t = table(spark, tmp_path)
    assert rows_of(t) == {} and t.version() == 0
    first = [(f"c{i}", d, float(i + d)) for i in range(40) for d in range(5)]
    assert t.insert(frame(spark, first + first[:7])) == {"inserted": 200, "ignored": 7, "buckets_read": 0, "buckets_written": 16}
    before = files_of(t)
    # New keys only: no bucket is read, and none is written anew.
    done = t.insert(frame(spark, [("new", 1, 1.0), ("new", 2, 2.0)]))
    assert done["inserted"] == 2 and done["buckets_read"] == 0 and done["buckets_written"] <= 2
    assert all(before[b] <= files_of(t)[b] for b in before)
    # A key that is there: its bucket alone is read.
    assert t.insert(frame(spark, [("c1", 0, 9.0), ("c1", 0, 8.0)])) == {"inserted": 0, "ignored": 2, "buckets_read": 1, "buckets_written": 0}
    before = files_of(t)
    assert t.update(frame(spark, [("c1", 0, None), ("c2", 0, 5.5), ("absent", 0, 1.0)])) == {"matched": 2, "buckets_read": 2, "buckets_written": 2}
    after = files_of(t)
    assert sum(before[b] != after[b] for b in after) == 2
    assert t.delete([("code", "=", "c3"), ("day", "=", 4)]) == {"deleted": 1, "buckets_read": 1, "buckets_written": 1}
    assert sum(after[b] != files_of(t).get(b) for b in after) == 1
    done = t.delete([("close", ">=", 42.0)])
    assert done["deleted"] == sum(c >= 42 for *_, c in first) and done["buckets_read"] == 16 > done["buckets_written"]
    assert t.delete([("code", "=", "nobody"), ("day", "=", 1)]) == {"deleted": 0, "buckets_read": 0, "buckets_written": 0}
    want = {(c, d): x for c, d, x in first if x < 42} | {("new", 1): 1.0, ("new", 2): 2.0, ("c1", 0): None, ("c2", 0): 5.5}
    del want["c3", 4]
    assert rows_of(t) == want
    assert t.vacuum() > 0 and rows_of(t) == want and t.vacuum() == 0


def test_a_failed_change_changes_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.insert(frame(spark, [("a", 1, 1.0)]))
    with monkeypatch.context() as m:
        m.setattr(BucketedTable, "_commit", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            t.update(frame(spark, [("a", 1, 2.0)]))
    assert rows_of(t) == {("a", 1): 1.0}
    live = t.live()
    t.insert(frame(spark, [("b", 1, 1.0)]))
    with pytest.raises(RuntimeError, match="another writer"):
        t._commit(live, t.version() - 1)
    assert set(rows_of(t)) == {("a", 1), ("b", 1)}


def test_many_generations_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "MOST_GENERATIONS", 2)
    t = table(spark, tmp_path, 1)
    for i in range(4):
        t.insert(frame(spark, [("a", i, float(i)), ("a", 0, 99.0)]))
    assert len(t.live()) == 4 and t.compact() == 1 and len(t.live()) == 1 and t.compact() == 0
    assert rows_of(t) == {("a", i): (99.0 if i == 0 and False else float(i)) for i in range(4)}
