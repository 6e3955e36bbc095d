"""Stored tables, roll-ups kept by streams, change logs, erasure and indexes: what is rewritten, what stays, what a failure leaves."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaywright.operators import analytics
from assaywright.operators.hash_index import HammingIndex
from assaywright.operators.hashing import matches
from assaywright.sources import tables
from assaywright.streaming import rollups


def paths(t: tables.StoredTable) -> set[str]:
    return {r["path"] for r in t.files().collect()}


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def scans(spark):
    k = F.col("id")
    return spark.range(4000).select((k * 7919 % 4001).alias("scan_id"), (k % 7).alias("tenant_id"), F.concat(F.lit("s"), k.cast("string")).alias("name"))


@pytest.fixture
def wide(spark):
    """Small partitions stay apart, so tables have several files."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lookups_open_files_that_can_hold_a_key(spark, scans, tmp_path, wide):
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", scans.schema, keys=("scan_id", "name"), order=("scan_id",))
    t.append(scans, "load")
    assert t.files().count() == 4
    got = t.lookup("scan_id", 17)
    assert rows_of(got) == rows_of(scans.filter("scan_id = 17")) and len(got.inputFiles()) == 1
    # not sorted by name: Bloom bits decide, and smallest and largest values cannot
    some = [f"s{i}" for i in range(0, 4000, 40)]
    opened = [t.holding("name", s).count() for s in some]
    assert min(opened) >= 1 and sum(opened) / len(opened) < 1.2
    assert rows_of(t.lookup("name", *some[:3])) == rows_of(scans.filter(F.col("name").isin(some[:3])))
    assert t.lookup("name", "s17x").inputFiles() == [] and t.lookup("scan_id", 99999).count() == 0


def test_null_keys_and_empty_tables(spark, tmp_path):
    schema = T.StructType.fromDDL("scan_id bigint, name string")
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", schema, keys=("scan_id",), order=("scan_id",))
    assert t.read().count() == 0 and t.versions() == []
    t.append(spark.createDataFrame([], schema), "nothing")
    assert t.read().count() == 0 and t.files().count() == 0
    t.append(spark.createDataFrame([(None, "a"), (1, None), (1, None)], schema), "some")
    assert rows_of(t.read()) == [(1, None), (1, None), (None, "a")]
    assert rows_of(t.lookup("scan_id", 1)) == [(1, None), (1, None)]
    log = tables.erase({"t": t}, spark.createDataFrame([(1,), (None,)], "scan_id bigint"), "r")
    assert rows_of(log) == [("t", 1, 2)] and rows_of(t.read()) == [(None, "a")]


def test_erasure_rewrites_only_what_it_must(spark, scans, tmp_path, wide):
    stores = {n: tables.StoredTable(spark, f"file://{tmp_path}/{n}", scans.schema, keys=("scan_id",), order=("scan_id",)) for n in ("a", "b")}
    for t in stores.values():
        t.append(scans, "load")
    before = {n: paths(t) for n, t in stores.items()}
    wanted = spark.createDataFrame([(5,), (9,), (5,), (123456,)], "scan_id bigint")
    log = rows_of(tables.erase(stores, wanted, "request-7"))
    assert log == [("a", 5, 1), ("a", 9, 1), ("b", 5, 1), ("b", 9, 1)]
    for n, t in stores.items():
        gone, stay = before[n] - paths(t), before[n] & paths(t)
        assert len(gone) == 1 and len(stay) == 3
        assert rows_of(t.read()) == rows_of(scans.filter("scan_id not in (5, 9)"))
        assert t.vacuum() >= 0 and t.read().count() == 3998 and t.done("load") and t.done("request-7")
    assert rows_of(tables.erase(stores, wanted, "request-7")) == log  # known by its note


def test_erasure_goes_on_after_a_failure(spark, scans, tmp_path, monkeypatch, wide):
    stores = {n: tables.StoredTable(spark, f"file://{tmp_path}/{n}", scans.schema, order=("scan_id",)) for n in ("a", "b")}
    for t in stores.values():
        t.append(scans, "load")
    wanted = spark.createDataFrame([(5,), (9,)], "scan_id bigint")
    whole = tables.StoredTable.commit

    def broken(self, *args):
        if self.root.endswith("/b"):
            raise OSError("lost")
        whole(self, *args)

    monkeypatch.setattr(tables.StoredTable, "commit", broken)
    with pytest.raises(OSError):
        tables.erase(stores, wanted, "r")
    assert stores["a"].read().count() == 3998 and stores["b"].read().count() == 4000  # the old version is whole
    first = stores["a"].versions()
    monkeypatch.setattr(tables.StoredTable, "commit", whole)
    log = rows_of(tables.erase(stores, wanted, "r"))
    assert log == [("a", 5, 1), ("a", 9, 1), ("b", 5, 1), ("b", 9, 1)]
    assert stores["a"].versions() == first and stores["b"].read().count() == 3998
    assert stores["b"].vacuum() >= 1  # what the failed attempt has written


def test_a_version_that_was_not_finished_is_not_seen(spark, scans, tmp_path):
    t = tables.StoredTable(spark, f"file://{tmp_path}/t", scans.schema, order=("scan_id",))
    t.append(scans, "load")
    t.files().limit(0).write.parquet(f"{t.root}/versions/00000002.broken")
    (tmp_path / "t/versions/00000002.broken/_SUCCESS").unlink()
    assert t.read().count() == 4000 and not t.done("broken")
    t.append(scans.limit(10), "more")
    assert t.read().count() == 4010 and t.versions() == ["00000001.load", "00000002.more"]


def test_rollups_are_those_of_a_batch(spark, tmp_path):
    rows = [(i % 3, f"2024-01-0{1 + i % 4} {i % 5:02d}:30:00", "ALLOW" if i % 2 else "BLOCK", i / 1000, float(i % 50)) for i in range(400)]
    df = spark.createDataFrame(rows, "tenant_id int, ts string, verdict string, risk_score double, duration_ms double").withColumn("ts", F.col("ts").cast("timestamp"))
    kept = rollups.hourly_verdicts(spark, f"file://{tmp_path}/state")
    days = [df.filter(F.dayofmonth("ts").isin(*some)) for some in ((1, 2), (2, 3, 4), (1,))]
    kept.merge(days[0], 0)
    first = {r["part"]: r["path"] for r in kept.table.files().collect()}
    kept.merge(days[1], 1)
    second = {r["part"]: r["path"] for r in kept.table.files().collect()}
    assert first["2024-01-01"] == second["2024-01-01"] and first["2024-01-02"] != second["2024-01-02"]  # only the batch's days
    kept.merge(days[1], 1)  # a replay
    kept.merge(days[2], 2)
    kept.merge(df.limit(0), 3)
    every = days[0].unionByName(days[1]).unionByName(days[2])
    assert rows_of(kept.state().select("tenant_id", "period", "verdict", "n", "risk_micro", "duration_micro")) == rows_of(analytics.additive_state(every, "hour"))


LOG = "id bigint, v string, seq bigint, op string"


def test_change_logs_against_a_dictionary(spark, tmp_path):
    rnd = random.Random(3)
    kept = tables.KeyedTable(spark, f"file://{tmp_path}/k", T.StructType.fromDDL("id bigint, v string"), ("id",), 4)
    log = [(rnd.randrange(40), rnd.choice("abc"), s, "delete" if rnd.random() < 0.3 else "upsert") for s in range(300)]
    rnd.shuffle(log)
    latest: dict[int, tuple] = {}
    for n in range(5):
        part = log[n * 60 : (n + 1) * 60] + rnd.sample(log[: n * 60 + 1], 1)
        kept.apply(spark.createDataFrame(part, LOG), f"batch-{n}")
        kept.apply(spark.createDataFrame(part, LOG), f"batch-{n}")
        for i, v, s, op in part:
            latest[i] = max(latest.get(i, (-1,)), (s, v, op))
        if n in (1, 3):
            kept.compact(f"compact-{n}")
            kinds = {r["kind"] for r in kept.table.files().collect()}
            assert kinds == {"base"}
        assert rows_of(kept.read()) == sorted(((i, v, s) for i, (s, v, op) in latest.items() if op != "delete"), key=repr)


def test_tombstones_outlive_compaction_until_the_horizon(spark, tmp_path):
    kept = tables.KeyedTable(spark, f"file://{tmp_path}/k", T.StructType.fromDDL("id bigint, v string"), ("id",), 2)
    kept.apply(spark.createDataFrame([(1, "a", 1, "upsert"), (1, None, 5, "delete")], LOG), "b0")
    kept.compact("c0")
    kept.apply(spark.createDataFrame([(1, "late", 3, "upsert")], LOG), "b1")
    assert kept.read().count() == 0  # the older change does not bring it back
    kept.compact("c1", horizon=6)
    assert kept.table.read().count() == 0
    before = paths(kept.table)
    kept.apply(spark.createDataFrame([(i, "x", 10, "upsert") for i in range(20)], LOG), "b2")
    assert kept.compact("c2", least=2) == [] and before <= paths(kept.table)


def test_stored_hashes_are_not_shuffled(spark, tmp_path):
    rnd = random.Random(5)
    base = [rnd.getrandbits(63) for _ in range(80)]
    refs = spark.createDataFrame([(f"r{i}", h) for i, h in enumerate(base)] + [("none", None)], "ref_id string, ref_h bigint")
    near = [(i, h ^ sum(1 << b for b in rnd.sample(range(64), i % 11)) - (0)) for i, h in enumerate(base)]
    near = [(i, h - (1 << 64) if h >> 63 else h) for i, h in near]
    queries = spark.createDataFrame(near + [(900, None)], "q bigint, h bigint")
    index = HammingIndex(spark, "hashes_of_a_test", f"file://{tmp_path}/index", 8, buckets=4)
    try:
        index.add(refs, 1)
        found = lambda: rows_of(index.lookup(queries).select("q", "ref_id", "distance"))
        exact = lambda r: rows_of(matches(queries, r, 8).select("q", "ref_id", "distance"))
        assert found() == exact(refs) and len(found()) >= 60
        assert rows_of(index.lookup(queries, 3).select("q", "ref_id", "distance")) == rows_of(matches(queries, refs, 3).select("q", "ref_id", "distance"))
        index.remove(refs.filter("ref_id in ('r1', 'r2')"), 2)
        assert found() == exact(refs.filter("ref_id not in ('r1', 'r2')"))
        index.add(refs.filter("ref_id = 'r2'"), 3)  # it comes back
        left = refs.filter("ref_id <> 'r1'")
        assert found() == exact(left)
        index.compact()
        assert found() == exact(left) and spark.table("hashes_of_a_test_removed").count() == 0
        plan = index.lookup(queries)._jdf.queryExecution().executedPlan().toString()
        join = plan[: plan.index("hashes_of_a_test_bands")]
        join = join[join.rindex("SortMergeJoin") :]  # the join with the bands, its left side, then the scan of the bands
        assert "Bucketed: true" in plan and "Exchange" in join and "Exchange" not in join[join.rindex("Scan ExistingRDD") :]
        with pytest.raises(ValueError):
            index.lookup(queries, 9)
    finally:
        index.drop()
    # the files outlive the catalog
    again = HammingIndex(spark, "hashes_of_a_test", f"file://{tmp_path}/index2", 8, buckets=4)
    assert again.lookup(queries).count() == 0
    again.drop()


@pytest.mark.parametrize("threshold", [2, 5, 8, 11])
def test_either_side_flips_half(spark, tmp_path, threshold):
    """All pairs within each distance, against brute force; a pair meets once in a band, and few variants are made of a hash."""
    rnd = random.Random(7)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    base = [rnd.getrandbits(64) for _ in range(12)]
    refs = [(f"r{i}", sign(x)) for i, x in enumerate(base)]
    queries = [(13 * i + d, sign(x ^ sum(1 << b for b in rnd.sample(range(rnd.choice((12, 22, 64))), d)))) for i, x in enumerate(base) for d in range(12)]
    index = HammingIndex(spark, f"halves_{threshold}", f"file://{tmp_path}/index", threshold, buckets=2)
    try:
        index.add(spark.createDataFrame(refs, "ref_id string, ref_h bigint"), 1)
        asked = spark.createDataFrame(queries, "q bigint, h bigint")
        for most in {threshold, threshold // 2, 0}:
            want = sorted((q, r, d) for q, h in queries for r, x in refs if (d := ((h ^ x) & ((1 << 64) - 1)).bit_count()) <= most)
            assert sorted(map(tuple, index.lookup(asked, most).select("q", "ref_id", "distance").collect())) == want
        stored_rows = spark.table(f"halves_{threshold}_bands").count() // len(refs)
        made = index._variants(asked.select("h").limit(1), "h", threshold // 3 - index.stored_flips).count()
        assert stored_rows <= 67 and made <= (718 if threshold > 8 else 67)
    finally:
        index.drop()
