import json
import os

import pytest

from tidewell.sources import versions

SHAPE = "k long, v string, w array<string>"


def rows(spark, path, **x):
    return sorted((r["k"], r["v"]) for r in versions.read(spark, path, **x).collect())


def test_an_upsert_is_a_version_of_the_buckets_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.upsert(spark, path, spark.createDataFrame([(k, f"a{k}", ["x"]) for k in range(300)], SHAPE), ["k"], 16) == 1
    before = versions.manifest(path)["files"]
    assert versions.upsert(spark, path, spark.createDataFrame([(7, "b7", None), (500, "b500", [])], SHAPE), ["k"], 16) == 2
    after = versions.manifest(path)["files"]
    assert rows(spark, path) == sorted([*((k, f"a{k}") for k in range(300) if k != 7), (7, "b7"), (500, "b500")])
    assert rows(spark, path, version=1) == [(k, f"a{k}") for k in range(300)]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and sum(map(len, after.values())) <= 18
    some = sorted(map(int, changed))
    assert {7, 500} <= {k for k, _ in rows(spark, path, buckets=some)} and len(rows(spark, path, buckets=some)) < 100


def test_what_fails_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.upsert(spark, path, spark.createDataFrame([(k, "a", None) for k in range(40)], SHAPE), ["k"], 4)
    files = sorted(os.listdir(f"{path}/data"))
    for bad in ([(1, "b", None), (1, "c", None)], [(None, "b", None), (2, "c", None)]):
        with pytest.raises(Exception, match="duplicate key|blank key"):
            versions.upsert(spark, path, spark.createDataFrame(bad, SHAPE), ["k"], 4)
    assert versions.versions(path) == [1] and rows(spark, path) == [(k, "a") for k in range(40)]
    # Files of a write that was killed before its commit are named by nothing.
    with open(f"{path}/data/stray.parquet", "wb") as f:
        f.write(b"half a file")
    assert rows(spark, path) == [(k, "a") for k in range(40)]
    os.remove(f"{path}/data/stray.parquet")
    assert sorted(os.listdir(f"{path}/data")) == files


def test_two_writers_from_one_version(spark, tmp_path, monkeypatch):
    """Another version comes in between: the commit fails, its files go, and the other's version is read."""
    path = str(tmp_path / "t")
    versions.upsert(spark, path, spark.createDataFrame([(1, "a", None)], SHAPE), ["k"], 4)
    first = versions.manifest(path)
    merge = versions.keys.merge

    def meanwhile(*x):
        with open(f"{path}/_versions/2.json", "w") as f:
            json.dump(first | {"version": 2}, f)
        return merge(*x)

    monkeypatch.setattr(versions.keys, "merge", meanwhile)
    with pytest.raises(Exception, match="FileExistsError|exists"):
        versions.upsert(spark, path, spark.createDataFrame([(1, "b", None)], SHAPE), ["k"], 4)
    assert rows(spark, path) == [(1, "a")] and versions.versions(path) == [1, 2]
    assert len(os.listdir(f"{path}/data")) == 1 and not [x for x in os.listdir(f"{path}/_versions") if x.endswith(".tmp")]


def test_no_table(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        versions.read(spark, str(tmp_path / "none"))
