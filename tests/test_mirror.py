"""Change capture: upsert, tombstones, replay, streams and runs."""

import json
from datetime import date

from pyspark.sql import functions as F

from daybook.streaming import cdc, mirror
from daybook.streaming.mirror import Mirror, detect_deletions, incremental_cursor, tombstone_missing, with_hash

SCHEMA = "company_id string, source_object_id string, guid string, name string, alter_id bigint"


def batch(spark, rows):
    return spark.createDataFrame([("CO1", k, f"g-{k}", n, v) for k, n, v in rows], SCHEMA)


def names(mirror):
    return {r["source_object_id"]: r["name"] for r in mirror.state().filter("NOT is_deleted").collect()}


def test_snapshot_v1_to_v2(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "ledgers")
    first = m.apply(batch(spark, [("a", "Alpha", 1), ("b", "Beta", 1), ("c", "Gamma", 1), (None, "no id", 1)]), 1, "r1", full_read=True).first()
    assert first["inserted"] == 3
    second = m.apply(batch(spark, [("a", "Alpha Ltd", 2), ("b", "Beta", 9), ("d", "Delta", 2)]), 2, "r2", full_read=True).first()
    assert (second["inserted"], second["updated"], second["unchanged"], second["tombstoned"]) == (1, 1, 1, 1)
    assert names(m) == {"a": "Alpha Ltd", "b": "Beta", "d": "Delta"}
    third = m.apply(batch(spark, [("c", "Gamma", 3)]), 3, "r3").first()
    assert third["updated"] == 1, "a tombstoned key that comes back is an update"
    assert names(m)["c"] == "Gamma"
    feed = {(r["source_object_id"], r["change"], r["version"]) for r in m.events().collect()}
    assert ("c", "DELETE", 2) in feed and ("c", "UPDATE", 3) in feed and ("b", "UPDATE", 2) not in feed


def test_replay_of_a_batch_changes_nothing(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v")
    m.apply(batch(spark, [("a", "A", 1), ("b", "B", 1)]), 1, "r1")
    m.apply(batch(spark, [("a", "A2", 2)]), 2, "r2")
    before, events = names(m), m.events().count()
    again = m.apply(batch(spark, [("a", "A2", 2)]), 2, "r2").first()
    assert again["updated"] == 1, "classified as the first time, written over the same delta"
    assert names(m) == before and m.events().count() == events
    m.compact(2)
    assert names(m) == before
    m.apply(batch(spark, [("b", "B3", 5)]), 3, "r3")
    assert names(m) == {"a": "A2", "b": "B3"}


def test_tombstone_guard(spark):
    state = with_hash(batch(spark, [(f"k{i}", "x", 1) for i in range(100)])).withColumn("is_deleted", F.lit(False))
    few, many = (tombstone_missing(state, batch(spark, [(f"k{i}", "x", 1) for i in range(n)]), "r") for n in (86, 84))
    assert (few.vanished, few.refused, few.rows.count()) == (14, None, 14)
    assert (many.vanished, many.refused, many.rows.count()) == (16, "IMPLAUSIBLE_SHARE", 0)
    keys = state.select("company_id", "guid", F.lit(None).cast("string").alias("source_object_id"))
    assert detect_deletions(state, keys.filter("guid != 'g-k7'"), "r").rows.first()["source_object_id"] == "k7"
    assert detect_deletions(state, keys.limit(0), "r").refused == "EMPTY_READ"


def test_cursor_replay_processes_nothing(spark):
    rows = batch(spark, [("a", "A", 5), ("b", "B", 9)])
    _, moved = incremental_cursor(rows, 4)
    assert tuple(moved.first()) == (2, 9)
    again, moved = incremental_cursor(rows, 9)
    assert again.count() == 0 and tuple(moved.first()) == (0, 9)


def test_stream_from_a_landing_folder(spark, tmp_path):
    landing, root = tmp_path / "in", tmp_path / "mirror"
    landing.mkdir()
    put = lambda name, rows: (landing / name).write_text("\n".join(json.dumps(dict(zip(("company_id", "source_object_id", "guid", "name", "alter_id"), ("CO1", k, k, n, v)))) for k, n, v in rows))
    schema = batch(spark, []).schema
    m = Mirror(spark, str(root), "vouchers")
    run = lambda: cdc.cdc_stream(cdc.landing_stream(spark, str(landing), schema), m, str(tmp_path / "ckpt")).awaitTermination()
    put("1.json", [("a", "A", 1), ("b", "B", 2), ("a", "A-late", 3)])
    run()
    assert names(m) == {"a": "A-late", "b": "B"}
    put("2.json", [("b", "B2", 4), ("c", "C", 5)])
    run()
    run()
    assert names(m) == {"a": "A-late", "b": "B2", "c": "C"}
    assert {(r["source_object_id"], r["change"]) for r in m.events().filter("version = 1").collect()} == {("b", "UPDATE"), ("c", "INSERT")}


def test_streams_and_syncs_write_one_after_another(spark, tmp_path):
    landing, root = tmp_path / "in", tmp_path / "mirror"
    landing.mkdir()
    put = lambda name, rows: (landing / name).write_text("\n".join(json.dumps(dict(zip(("company_id", "source_object_id", "guid", "name", "alter_id"), ("CO1", k, k, n, v)))) for k, n, v in rows))
    schema = batch(spark, []).schema
    m = Mirror(spark, str(root), "ledgers")
    run = lambda ckpt: cdc.cdc_stream(cdc.landing_stream(spark, str(landing), schema), m, str(tmp_path / ckpt)).awaitTermination()
    put("1.json", [("a", "A", 1), ("b", "B", 1)])
    run("one")
    put("2.json", [("c", "C", 1)])
    run("two")
    assert names(m) == {"a": "A", "b": "B", "c": "C"}, "batch 0 of a new checkpoint does not replace batch 0 of the old one"
    cdc.sync_run(spark, str(root), "CO1", {"ledgers": batch(spark, [("a", "new", 5), ("b", "B", 1), ("c", "C", 1)])}, 5)
    put("3.json", [("a", "newest", 9)])
    run("two")
    assert names(m)["a"] == "newest"


def test_replay_after_compaction_keeps_the_events(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v")
    m.apply(batch(spark, [("a", "A", 1), ("b", "B", 1)]), 1, "r1")
    m.apply(batch(spark, [("a", "A2", 2)]), 2, "r2")
    before, events = names(m), m.events().count()
    m.compact(2)
    again = m.apply(batch(spark, [("a", "A2", 2)]), 2, "r2").first()
    assert again["updated"] == 1 and m.events().count() == events and names(m) == before
    assert m.apply(batch(spark, [("a", "A2", 2), (None, "no id", 2)]), 3, "r3").first()["skipped"] == 1


VOUCHERS = "company_id string, source_object_id string, voucher_date date, amount int, alter_id bigint"


def vouchers(spark, rows):
    return spark.createDataFrame([(co, k, date(2024, month, 1), amount, v) for co, k, month, amount, v in rows], VOUCHERS)


def formatted(spark, df):
    return spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def live(df):
    return sorted((r["company_id"], r["source_object_id"], r["voucher_date"].month, r["amount"]) for r in df.collect())


def test_company_and_date_reach_the_scan_of_the_base(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "vouchers")
    m.apply(vouchers(spark, [(co, f"k{i}", i + 1, i, 1) for co in ("001", "1") for i in range(12)]), 1, "r1")
    m.compact(1)
    m.apply(vouchers(spark, [("001", "k2", 9, 20, 2), ("001", "k5", 3, 50, 2), ("1", "new", 3, 7, 2)]), 2, "r2")
    march = mirror.scan_mirror_vouchers(m, "001", date(2024, 3, 1), date(2024, 4, 30))
    assert live(march) == [("001", "k3", 4, 3), ("001", "k5", 3, 50)], "a moved voucher is found at its new date only"
    assert len(live(m.read("1"))) == 13
    scan = formatted(spark, march).split("PushedFilters")
    assert any("GreaterThanOrEqual(voucher_date" in x.split("ReadSchema")[0] for x in scan)
    assert any("PartitionFilters" in x and "= c-001)" in x.split("PartitionFilters")[1] for x in scan)


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v", buckets=8)
    m.apply(batch(spark, [(f"k{i}", "x", 1) for i in range(200)]), 1, "r1")
    few = spark.createDataFrame([("k1",), ("k2",)], "source_object_id string").select(m.bucket()).distinct()
    picked = [r[0] for r in few.collect()]
    read = m.state(buckets=picked)
    assert 0 < read.count() < 200 and {f.split("bucket=")[1].split("/")[0] for f in read.inputFiles()} >= {str(b) for b in picked}
    assert "bucket#" in formatted(spark, read).split("PartitionFilters")[1].split("ReadSchema")[0]
    stats = m.apply(batch(spark, [("k1", "y", 2), ("k2", "x", 2), ("k900", "z", 2)]), 2, "r2").first()
    assert (stats["inserted"], stats["updated"], stats["unchanged"]) == (1, 1, 1) and len(names(m)) == 201


def test_the_list_of_a_state_stays_short(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v", buckets=2, compact_every=3)
    for n in range(1, 12):
        m.apply(batch(spark, [("a", f"A{n}", n), (f"k{n}", "x", n)]), n, f"r{n}", writer="w")
        assert len(m._listed()) <= 8
    assert names(m) == {"a": "A11", **{f"k{n}": "x" for n in range(1, 12)}}
    assert m.events().count() == 22
    assert m.apply(batch(spark, [("a", "A2", 2), ("k2", "x", 2)]), 2, "r2", writer="w").first()["total"] == 2, "an old batch finds its version in an epoch before"
    assert names(m)["a"] == "A11" and m.events().count() == 22
    gone = m.vacuum(9)
    assert gone and names(m)["a"] == "A11" and len(names(m)) == 12
    assert {r["version"] for r in m.events().select("version").distinct().collect()} >= {10, 11}


def test_a_batch_that_was_not_committed_is_not_read(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v")
    m.apply(batch(spark, [("a", "A", 1)]), 1, "r1", writer="w")
    version = m.version_of(2, "w")
    m._write(with_hash(batch(spark, [("a", "half", 2)])), "delta", version)
    assert names(m) == {"a": "A"}
    assert m.apply(batch(spark, [("a", "A2", 2)]), 2, "r2", writer="w").first()["updated"] == 1
    assert names(m) == {"a": "A2"} and m.version_of(2, "w") == version and m.version_of(3, "w") == version + 1


def test_a_batch_without_changes_after_a_compaction(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v")
    m.apply(batch(spark, [("a", "A", 1)]), 1, "r1")
    m.compact(1)
    assert m.apply(batch(spark, [("a", "A", 2)]).drop("alter_id").withColumn("alter_id", F.lit(1).cast("bigint")), 2, "r2").first()["unchanged"] == 1
    assert names(m) == {"a": "A"} and m.read("CO1").count() == 1
    assert m.apply(batch(spark, [("a", "A3", 3)]), 3, "r3").first()["updated"] == 1
    assert names(m) == {"a": "A3"}


def test_a_full_read_of_one_company_leaves_the_others(spark, tmp_path):
    m = Mirror(spark, str(tmp_path), "v")
    m.apply(vouchers(spark, [(co, k, 1, 1, 1) for co in ("A", "B", None) for k in "xyz"]), 1, "r1")
    stats = m.apply(vouchers(spark, [("A", "x", 1, 1, 2), ("A", "y", 1, 5, 2)]), 2, "r2", full_read=True, company="A").first()
    assert (stats["tombstoned"], stats["updated"], stats["unchanged"]) == (1, 1, 1)
    assert live(m.read("A")) == [("A", "x", 1, 1), ("A", "y", 1, 5)] and len(live(m.read("B"))) == 3
    assert m.state().filter("company_id is null").count() == 3


def test_sync_run_goes_on_after_a_failed_domain(spark, tmp_path):
    good = batch(spark, [("a", "A", 1)])
    log = cdc.sync_run(spark, str(tmp_path), "CO1", {"vouchers": good, "units": None, "ledgers": good.drop("alter_id")}, 1)
    rows = {r["domain"]: r for r in log.collect()}
    assert [r["domain"] for r in log.collect()][-1] == "vouchers"
    assert (rows["vouchers"]["status"], rows["units"]["status"], rows["ledgers"]["status"]) == ("SUCCESS", "SKIPPED", "FAILED")
    assert rows["vouchers"]["run_status"] == "PARTIAL"


def test_daily_totals_stream_is_final_after_the_watermark(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    types = spark.createDataFrame([("Sales", "Sales")], "name string, parent string")
    write = lambda n, rows: (landing / n).write_text("\n".join(json.dumps({"voucher_type": "Sales", "voucher_date": d, "amount": a, "is_cancelled": False}) for d, a in rows))
    write("1.json", [("2024-01-01", 10), ("2024-01-01", 5)])
    src = cdc.landing_stream(spark, str(landing), spark.createDataFrame([], "voucher_type string, voucher_date date, amount decimal(18,2), is_cancelled boolean").schema, files_per_batch=1)
    out = cdc.streaming_daily(src, types)
    q = out.writeStream.outputMode("append").format("memory").queryName("daily").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    write("2.json", [("2024-02-01", 1)])
    q.processAllAvailable()
    write("3.json", [("2024-02-02", 1)])
    q.processAllAvailable()
    q.stop()
    assert [(str(r["day"])[:10], float(r["amount"])) for r in spark.table("daily").collect()] == [("2024-01-01", 15.0)]
