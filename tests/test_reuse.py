"""Result reuse with expiry: batch, stream in several batches, store."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from billgrain.operators import intake, reuse
from billgrain.sources import readers, store
from billgrain.streaming import jobs

START = dt.datetime(2024, 1, 1)


def arrivals(seed=1, count=600):
    rnd = random.Random(seed)
    keys = ["hot"] * 3 + ["a", "b", "c", "d", "e", "f"]
    return [
        (rnd.choice(keys), START + dt.timedelta(minutes=rnd.randint(0, 9 * 24 * 60)), i) for i in range(count)
    ]


def brute_force(rows):
    last, hits = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        if key in last and ts - last[key] < dt.timedelta(hours=24):
            hits[i] = True
        else:
            last[key], hits[i] = ts, False
    return hits


def frame(spark, rows):
    return spark.createDataFrame(rows, "hash string, ts timestamp, arrival_id bigint")


@pytest.mark.parametrize("seed", [1, 2])
def test_like_brute_force(spark, seed):
    rows = arrivals(seed)
    got = reuse.with_reuse(frame(spark, rows))
    assert {r.arrival_id: r.is_hit for r in got.collect()} == brute_force(rows)


def test_bursts_and_long_gaps(spark):
    """A hot hash in bursts of equal and nearly equal times, with gaps of many days between."""
    rnd = random.Random(3)
    moments = [START + dt.timedelta(days=d, microseconds=rnd.randint(0, 5)) for d in (0, 1, 2, 40, 41, 400) for _ in range(30)]
    moments += [START + dt.timedelta(days=100 + d, microseconds=-d) for d in range(20)]
    rows = [("hot", ts, i) for i, ts in enumerate(moments)] + [("cold", START, 10_000), ("before", dt.datetime(1960, 5, 1), 10_001)]
    got = reuse.with_reuse(frame(spark, rows))
    assert {r.arrival_id: r.is_hit for r in got.collect()} == brute_force(rows)


def test_expiry_is_not_prolonged_by_hits(spark):
    hours = [0, 12, 23.999, 24, 30, 47.9, 48]
    rows = [("k", START + dt.timedelta(hours=h), i) for i, h in enumerate(hours)]
    got = sorted(reuse.with_reuse(frame(spark, rows)).collect(), key=lambda r: r.arrival_id)
    assert [r.is_hit for r in got] == [False, True, True, False, True, True, False]


def test_no_arrivals(spark):
    assert reuse.with_reuse(frame(spark, [])).collect() == []


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_stream_over_several_batches(spark, tmp_path, parts):
    rows = sorted(arrivals(4, 300), key=lambda r: r[1])
    rows += [(None, START, 1000), ("a", None, 1001), (None, START, 1002), ("a", None, 1003)]
    size = -(-len(rows) // parts)
    for part in range(parts):
        frame(spark, rows[part * size : (part + 1) * size]).coalesce(1).write.mode("append").parquet(str(tmp_path))
    schema = "hash string, ts timestamp, arrival_id bigint"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = jobs.with_reuse(stream)
    expected = {**brute_force(rows[:300]), 1000: False, 1001: False, 1002: False, 1003: False}
    assert {r.arrival_id: r.is_hit for r in got.collect()} == expected and got.count() == len(rows)


@pytest.mark.parametrize("parts, delay", [(2, 30), (5, 30), (9, 50)])
def test_disorder_within_the_delay_changes_nothing(spark, tmp_path, parts, delay):
    rows = sorted(arrivals(7, 250), key=lambda r: r[1])
    shaken = random.Random(parts)
    rows = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=shaken.uniform(0, delay)))
    moments = [r[1] for r in rows]
    # nothing comes later than the delay allows
    assert all(max(moments[: i + 1]) - t <= dt.timedelta(hours=delay) for i, t in enumerate(moments))
    size = -(-len(rows) // parts)
    for part in range(parts):
        frame(spark, rows[part * size : (part + 1) * size]).coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("hash string, ts timestamp, arrival_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = jobs.with_reuse(stream, delay_hours=delay)
    assert {r.arrival_id: r.is_hit for r in got.collect()} == brute_force(rows) and got.count() == len(rows)


def test_a_named_stream_keeps_what_waits(spark, tmp_path):
    rows = sorted(arrivals(8, 120), key=lambda r: r[1])
    schema, name = "hash string, ts timestamp, arrival_id bigint", f"test-{random.random()}"
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path))
    first, second = rows[:90:2] + rows[90:91], rows[1:90:2] + rows[91:]
    delay = (rows[90][1] - rows[0][1]).total_seconds() / 3600 + 1
    frame(spark, first).coalesce(1).write.mode("append").parquet(str(tmp_path))
    assert jobs.with_reuse(stream(), name, delay_hours=delay, finish=False).count() == 0
    frame(spark, second).coalesce(1).write.mode("append").parquet(str(tmp_path))
    got = jobs.with_reuse(stream(), name, delay_hours=delay)
    assert {r.arrival_id: r.is_hit for r in got.collect()} == brute_force(rows) and got.count() == 120


def test_a_batch_writes_its_own_misses_only(spark, tmp_path):
    for day in range(4):
        rows = [(f"h{day}-{i}", START + dt.timedelta(days=3 * day, seconds=i), 10 * day + i) for i in range(10)]
        frame(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path))
    name = f"test-{random.random()}"
    stream = spark.readStream.schema("hash string, ts timestamp, arrival_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    jobs.with_reuse(stream, name)
    log = spark.read.schema(jobs.MISSES).parquet(f"{jobs.folder(spark, name)}/misses")
    assert {r.batch: r["count"] for r in log.groupBy("batch").count().collect()} == {i: 10 for i in range(4)}
    # a batch that is run again leaves the same rows
    job = jobs._ReuseJob(spark, jobs.folder(spark, name), log.sparkSession.read.parquet(str(tmp_path)).schema, 24, None)
    job.flag(spark.read.parquet(str(tmp_path)).filter("arrival_id >= 30"), 3)
    assert log.sparkSession.read.schema(jobs.MISSES).parquet(f"{jobs.folder(spark, name)}/misses").count() == 40


def test_a_named_stream_goes_on(spark, tmp_path):
    rows = sorted(arrivals(6, 100), key=lambda r: r[1])
    schema, name = "hash string, ts timestamp, arrival_id bigint", f"test-{random.random()}"
    for part in (rows[:60], rows[60:]):
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path))
        got = jobs.with_reuse(spark.readStream.schema(schema).parquet(str(tmp_path)), name)
    assert {r.arrival_id: r.is_hit for r in got.collect()} == brute_force(rows) and got.count() == 100


@pytest.mark.parametrize("parts", [1, 3, 6])
def test_hourly_counts_do_not_depend_on_batches(spark, tmp_path, parts):
    rows = arrivals(5, 300)
    random.Random(2).shuffle(rows)  # out of time order across batches
    flagged = [(key, ts, i, i % 3 == 0) for key, ts, i in rows]
    for part in range(parts):
        some = spark.createDataFrame(flagged[part::parts], "hash string, ts timestamp, arrival_id bigint, is_hit boolean")
        some.coalesce(1).write.mode("append").parquet(str(tmp_path))
    stream = spark.readStream.schema("hash string, ts timestamp, arrival_id bigint, is_hit boolean")
    got = jobs.latest(jobs.hourly_counts(stream.option("maxFilesPerTrigger", 1).parquet(str(tmp_path)))).collect()
    expected = {}
    for _, ts, _, hit in flagged:
        hour = ts.replace(minute=0)
        hits, misses = expected.get(hour, (0, 0))
        expected[hour] = (hits + hit, misses + (not hit))
    assert {r.hour: (r.hits, r.misses) for r in got} == expected


def test_first_of_each(spark):
    df = spark.createDataFrame([("x", 3), ("x", 1), ("y", 2)], "hash string, doc_id int")
    got = {r.hash: (r.doc_id, r.n_copies) for r in reuse.first_of_each(df, "doc_id").collect()}
    assert got == {"x": (1, 2), "y": (2, 1)}


def test_documents_without_a_hash_are_never_copies(spark):
    df = spark.createDataFrame([("x", 1), (None, 2), (None, 3), ("x", 4)], "hash string, doc_id int")
    got = sorted((r.doc_id, r.n_copies) for r in reuse.first_of_each(df, "doc_id").collect())
    assert got == [(1, 2), (2, 1), (3, 1)]


def test_arrivals_without_hash_or_time_are_misses(spark):
    rows = [("x", None, 1), ("x", "2024-01-01 00:00:00", 2), ("x", "2024-01-01 05:00:00", 3), ("x", None, 4), (None, "2024-01-01 00:00:00", 5), (None, "2024-01-01 01:00:00", 6)]
    df = spark.createDataFrame(rows, "hash string, ts string, arrival_id int").withColumn("ts", F.to_timestamp("ts"))
    got = {r.arrival_id: r.is_hit for r in reuse.with_reuse(df).collect()}
    assert got == {1: False, 2: False, 3: True, 4: False, 5: False, 6: False}


def test_admission_order_and_limits(spark):
    limit = 10 * 1024 * 1024
    rows = [("text/plain", 0, "unsupported_type"), ("application/pdf", 0, "empty"), ("image/heif", limit, None), ("image/heif", limit + 1, "too_large"), (None, 1, "unsupported_type")]
    df = spark.createDataFrame(rows, "content_type string, length bigint, expected string")
    for r in intake.admit(df).collect():
        assert r.reject_reason == r.expected


def test_document_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 dummy invoice content")
    (tmp_path / "b.PNG").write_bytes(b"x")
    docs = {r.path[-5:]: r for r in intake.with_hash(readers.documents(spark, str(tmp_path))).collect()}
    assert docs["a.pdf"].hash == hashlib.sha256(b"%PDF-1.4 dummy invoice content").hexdigest()
    assert docs["b.PNG"].content_type == "image/png" and docs["b.PNG"].hash is None


def test_pages_from_json(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"doc_id":1,"page_number":2,"regions":[{"type":"table","bbox":[1,2,3,4],"res":{"html":"<t>"}},'
        '{"type":"text","res":[{"text":"a","confidence":0.5}]},{"type":"title","res":"plain"},{"res":{"text":"t"}}]}\n'
    )
    row = readers.pages(spark, str(tmp_path)).first()
    assert [r.res_kind for r in row.regions] == ["dict", "list", "str", "dict"]
    assert row.regions[0].html == "<t>" and row.regions[1]["items"][0].text == "a"
    assert row.regions[2].text == "plain" and row.regions[3].text == "t" and row.regions[3].type is None
    assert (row.height, row.width) == (1000.0, 800.0)


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    now = F.lit(START)
    assert store.live(spark, path, now).count() == 0 and store.clear(spark, path) == 0
    df = spark.createDataFrame([("h1", "a"), ("h1", "a"), ("h2", "b"), (None, "image")], "hash string, name string")
    results = df.select("hash", F.struct("name").alias("invoice"))
    store.append(results, path, now)
    at = lambda hours: F.lit(START + dt.timedelta(hours=hours))
    assert store.live(spark, path, at(23.9)).count() == 2
    assert store.live(spark, path, at(24)).count() == 0
    store.append(results.filter("hash = 'h1'"), path, at(30))
    assert [r.hash for r in store.live(spark, path, at(31)).collect()] == ["h1"]
    plan = store.live(spark, path, at(31))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cached_date" in plan
    assert store.clear(spark, path) == 2
    assert store.live(spark, path, at(31)).count() == 0


def test_store_keeps_invoices_with_their_nulls(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = [("h1", START, "a", None), ("h1", START + dt.timedelta(hours=2), "b", 1.5), ("h2", START, None, None), (None, START, "image", None)]
    df = spark.createDataFrame(rows, "hash string, came timestamp, name string, total double")
    store.append(df.select("hash", "came", F.struct("name", "total").alias("invoice")), path, F.col("came"))
    docs = spark.createDataFrame([(1, "h1"), (2, "h1"), (3, "h2"), (4, "h3"), (5, None)], "doc_id int, hash string")
    found = store.lookup(docs, path, F.lit(START + dt.timedelta(hours=3))).collect()
    assert {r.doc_id: r.invoice for r in found} == {1: '{"name":"b","total":1.5}', 2: '{"name":"b","total":1.5}', 3: '{"name":null,"total":null}'}
    assert all(r.errors == [] and r.warnings == [] and r.is_valid and r.processing_method == "cache_hit" for r in found)
    late = store.lookup(docs, path, F.lit(START + dt.timedelta(hours=25)))
    assert {r.doc_id for r in late.collect()} == {1, 2}


def test_a_lookup_does_not_shuffle_the_store(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(f"h{i}", str(i)) for i in range(100)], "hash string, name string")
    for _ in range(2):
        store.append(df.select("hash", F.struct("name").alias("invoice")), path, F.lit(START))
    docs = spark.createDataFrame([(i, f"h{i % 70}") for i in range(500)], "doc_id int, hash string")
    found = store.lookup(docs, path, F.lit(START))
    assert found.count() == 500
    plan = found._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("== Initial Plan ==") :].splitlines() if "== Initial Plan ==" in plan else plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    depth = len(lines[scan]) - len(lines[scan].lstrip(" :+-"))
    above = []
    for line in reversed(lines[:scan]):  # what stands between the scan and the root
        if len(line) - len(line.lstrip(" :+-")) < depth:
            depth = len(line) - len(line.lstrip(" :+-"))
            above.append(line.strip(" :+-"))
    join = next(i for i, line in enumerate(above) if "Join" in line)
    assert not any(line.startswith("Exchange") for line in above[:join]), above
    kept = store.live(spark, path, F.lit(START))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in kept
