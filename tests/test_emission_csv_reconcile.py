"""Results in chunks, CSV loads, reconciliation by branches and keys, and documents that are purged."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaylight import schema as S
from quaylight.operators import emission, ingest, quality, results
from quaylight.sources import folders

from . import fixtures as X


@pytest.fixture()
def dim(spark):
    return spark.createDataFrame(X.FUTURES, S.INSTRUMENTS)


def test_chunks_come_in_order_and_go_on(spark, tmp_path):
    path = str(tmp_path / "out")
    result = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("ts_recv"), F.col("id").alias("x")).repartition(6).orderBy("ts_recv", "x")
    listed = emission.emit(result, path, records_per_file=90)
    rows = listed.orderBy("number").collect()
    assert [r.number for r in rows] == list(range(len(rows))) and len(rows) >= 12 and max(r.n_records for r in rows) <= 90
    assert [r.n_before for r in rows] == [sum(p.n_records for p in rows[:i]) for i in range(len(rows))]
    got, seen = [], []
    for c in emission.chunks(spark, path):
        part = [r.ts_recv for r in c.records.collect()]
        assert (len(part), part[0], part[-1], c.n_before) == (c.n_records, c.first_ts, c.last_ts, len(got))
        got += part
        seen.append(c.number)
    assert got == list(range(1000)) and emission.steps_between(listed).isEmpty()
    # A reader that stopped after the fifth goes on with the sixth; one that wants a time on begins with its chunk.
    assert [c.number for c in emission.chunks(spark, path, after=4)] == seen[5:]
    late = next(emission.chunks(spark, path, from_ts=555))
    assert late.first_ts <= 555 <= late.last_ts
    assert [r.ts_recv for r in late.records.toLocalIterator()] == list(range(late.first_ts, late.last_ts + 1))


def test_an_empty_result_has_a_manifest(spark, tmp_path):
    path = str(tmp_path / "out")
    assert emission.emit(spark.createDataFrame([], "ts_recv long"), path).count() == 0
    assert list(emission.chunks(spark, path)) == []


def test_steps_between_chunks(spark):
    listed = spark.createDataFrame([(0, "a", 2, 1, 5, 0), (1, "b", 2, 4, 9, 2), (2, "c", 1, 9, 9, 4)], emission.MANIFEST)
    assert [r.number for r in emission.steps_between(listed).collect()] == [1]


HEADER = ",".join([f.name for f in ingest.csv_schema(2).fields if f.name != "_line"])


def line(i, t, price="5", tail="1,2,3,4,5,6,,,,,,", **_):
    return f"mbp-1,futures,{i},{t},{price},1,84,65,0,{t},0,7,0,{tail}"


def test_csv_lines_are_parsed_or_counted(spark, dim, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    os.makedirs(source)
    good = [line(1, X.D1), line(2, X.D1, tail="1,2,3,4,5,6,7,8,9,10,11,12"), line(1, X.D2, tail=",,,,,,,,,,,")]
    bad = [line(1, X.D1 + 1, "five"), line(1, X.D1 + 2, ""), "mbp-1,futures,1", line(1, X.D1 + 3) + ",9,9", "é;x"]
    for k, some in enumerate((good[:1] + bad[:3], good[1:] + bad[3:])):
        (tmp_path / "in" / f"{k}.csv").write_text("\n".join([HEADER, *some]) + "\n")
    records, rejected = ingest.read_csv(spark, source, depth=2)
    assert records.count() == 3 and rejected.count() == 5 and records.schema.names == S.RAW.names
    got = {(r.instrument_id, r.ts_recv): [tuple(v) for v in r.levels] for r in records.collect()}
    # In a line prices come first, as in a book; in a level its bid side does.
    assert got == {(1, X.D1): [(0, 1, 3, 5, 2, 4, 6)], (2, X.D1): [(0, 1, 3, 5, 2, 4, 6), (1, 7, 9, 11, 8, 10, 12)], (1, X.D2): []}
    with pytest.raises(ingest.Rejected, match="5 lines"):
        ingest.load_csv(spark, source, store, dim, "a", depth=2, most_rejected=4)
    assert ingest.read_store(spark, store).count() == 0
    done = ingest.load_csv(spark, source, store, dim, "a", depth=2, most_rejected=5)
    assert (done.n_rows, done.n_rejected, done.status) == (3, 5, "success") and ingest.read_store(spark, store).count() == 3
    other = ingest.prepare(records, "x", 0).select("instrument_id", "ts_recv", "order_book_hash")
    assert ingest.read_store(spark, store).select(*other.columns).exceptAll(other).isEmpty()


ROW = st.tuples(st.integers(0, 2), st.integers(0, 1), st.integers(0, 3), st.one_of(st.none(), st.integers(0, 2)), st.sampled_from(["x", "y", None]))


def plain_diff(left, right):
    """For each key the copies of both sides in the order of their values, one beside the other."""
    out = []
    order = lambda r: [(v is not None, v if v is not None else 0) for v in r[3:4]] + [(r[4] is not None, r[4] or "")]
    for key in {r[:3] for r in left + right}:
        a, b = (sorted((r for r in side if r[:3] == key), key=order) for side in (left, right))
        for x, y in zip(a, b):
            if changed := ",".join(n for n, p, q in zip(("v", "w"), x[3:], y[3:]) if p != q):
                out.append((*key, "changed", changed))
        out += [(*key, "left", "")] * (len(a) - len(b)) + [(*key, "right", "")] * (len(b) - len(a))
    return sorted(out)


@given(st.lists(ROW, max_size=12), st.lists(ROW, max_size=6), st.integers(0, 6))
@settings(max_examples=10, deadline=None)
def test_keyed_reconciliation_against_plain(spark, rows, more, drop):
    # Branches in which only some copies differ are compared as a whole, like those of the plain version.
    left, right = rows, rows[: max(0, len(rows) - drop)] + more
    one, two = (spark.createDataFrame(r, "day long, i long, k long, v long, w string") for r in (left, right))
    got = sorted(map(tuple, quality.reconcile_keyed(one, two, ["day", "i", "k"], ["day", "i"]).collect()))
    assert got == plain_diff(left, right)


def test_equal_days_are_read_once(spark, tmp_path):
    """Rows are only compared on the days that differ; others are left with one look, at their sums."""
    rows = [(d, i, k, k) for d in range(10) for i in range(3) for k in range(4)]
    one = spark.createDataFrame(rows, "day long, i long, k long, v long")
    one.write.partitionBy("day").parquet(str(tmp_path / "a"))
    one.withColumn("v", F.when((F.col("day") == 4) & (F.col("i") == 1) & (F.col("k") == 2), 99).otherwise(F.col("v"))).write.partitionBy("day").parquet(str(tmp_path / "b"))
    a, b = (spark.read.schema("i long, k long, v long, day long").parquet(str(tmp_path / p)).select("day", "i", "k", "v") for p in "ab")
    got = quality.reconcile_keyed(a, b, ["day", "i", "k"], ["day", "i"])
    scans = [x for x in got._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x and ("/a]" in x or "/b]" in x)]
    assert len(scans) == 2 and all("day#" in x.split("PartitionFilters")[1].split("]")[0] and "4" in x.split("PartitionFilters")[1].split("]")[0] for x in scans)
    assert [tuple(r) for r in got.collect()] == [(4, 1, 2, "changed", "v")]
    assert quality.reconcile_keyed(a, a, ["day", "i", "k"], ["day", "i"]).isEmpty()


def documents(spark, *ids):
    return {n: spark.createDataFrame([(i, f"d{i}") for i in ids], "doc_id long, name string").withColumn("kind", F.lit(k)) for k in ("live",) for n in results.PARTS[k]}


def test_purged_documents_leave_the_files(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "docs")
    results.write_tables(documents(spark, 1, 2, 3), folder)
    assert not results.purge(spark, folder)
    results.delete_stored(spark.createDataFrame([(2,)], "doc_id long"), folder, "live")
    left = lambda: {n: sorted(r.doc_id for r in t.collect()) for n, t in results.read_tables(spark, folder, "live").items()}
    want = left()
    with monkeypatch.context() as m:
        m.setattr(results, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            results.purge(spark, folder)
    assert left() == want
    assert results.purge(spark, folder) and left() == want and not results.purge(spark, folder)
    base = results._base(spark, folder)
    assert base != folder and not os.path.exists(f"{folder}/header") and not os.path.exists(f"{base}/deleted")
    assert all(spark.read.parquet(f"{base}/{n}").where("doc_id = 2").isEmpty() for n in results.PARTS["live"])
    # Documents are added, deleted and purged again.
    results.write_tables(documents(spark, 4), folder)
    results.delete_stored(spark.createDataFrame([(1,)], "doc_id long"), folder, "live")
    assert results.purge(spark, folder) and left() == {n: [3, 4] for n in results.PARTS["live"]}
    assert len(folders.published(spark, folder)) == 1 and not os.path.exists(base)


def test_repeats_of_a_later_batch(spark, tmp_path):
    """A repeat in a later batch is dropped inside the watermark; long after it, its state is gone and it passes."""
    from quaylight.streaming.ingest_stream import recent_duplicates_dropped

    source, out = str(tmp_path / "in"), str(tmp_path / "out")

    def send(*rows):
        ingest.prepare(spark.createDataFrame(rows, S.RAW).coalesce(1), "x", 0).write.mode("append").parquet(source)
        stream = recent_duplicates_dropped(spark.readStream.schema(S.MBP).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(S.MBP).parquet(out).count()

    one, hour = X.raw("futures", 1, X.D1, 1, 1), 3600 * S.SECOND
    assert send(one) == 1
    assert send(one, X.raw("futures", 1, X.D1 + 5 * S.MINUTE, 1, 1)) == 2
    assert send(X.raw("futures", 1, X.D1 + hour, 1, 1)) == 3
    # Its state is gone, and it comes behind the watermark: it is late and dropped for that.
    assert send(one) == 3
    again = X.raw("futures", 1, X.D1 + hour, 1, 1)
    assert send(again, X.raw("futures", 1, X.D1 + 2 * hour, 1, 1)) == 4
