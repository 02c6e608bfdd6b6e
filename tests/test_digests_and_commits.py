"""Digests against hashlib, and the log of commits under writers that compete or die."""

import hashlib
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from siltstone.operators import digests
from siltstone.sources import commits, documents


def test_set_digests_fold_in_order(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "b", None]), "".join(rnd.choice("aé漢 \nZ") for _ in range(rnd.randint(0, 5)))) for _ in range(3000)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v string").repartition(7)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        found = {r.g: (r.n, r.digest) for r in digests.set_digest(df, "v", ["g"]).collect()}
        whole = digests.set_digest(df, "v", []).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    for g in ("a", "b", None):
        values = sorted({v for k, v in rows if k == g and v is not None}, key=str.encode)
        assert found[g] == (len(values), hashlib.sha256("\n".join(values).encode()).hexdigest())
    values = sorted({v for _, v in rows if v is not None}, key=str.encode)
    assert "c" not in found and (whole.n, whole.digest) == (len(values), hashlib.sha256("\n".join(values).encode()).hexdigest())


def test_score_digests_have_the_shortest_texts(spark):
    rnd = random.Random(2)
    scores = [(k % 2, k, rnd.choice([0.1, 1.0, 1e16, 1e-7, -0.0, 2.675, None, rnd.random(), rnd.uniform(-1e9, 1e9)])) for k in range(500)]
    df = spark.createDataFrame(scores, "g int, k int, x double").repartition(5)
    for r in digests.score_digest(df, "x", ["g"], ["k"]).collect():
        values = [x for g, _, x in scores if g == r.g]
        assert (r.n, r.digest) == (len(values), hashlib.sha256(json.dumps(values, separators=(",", ":")).encode()).hexdigest())


@pytest.mark.parametrize("chunk", [1, 1000, 1 << 22])
def test_file_digests_by_chunks(spark, tmp_path, chunk):
    rnd = random.Random(3)
    want = {}
    for i, size in enumerate([0, 1, 999, 1000, 1001, 50_000]):
        raw = rnd.randbytes(size)
        (tmp_path / f"{i}").write_bytes(raw)
        want[str(i)] = hashlib.md5(raw).hexdigest()
    (tmp_path / "a folder").mkdir()
    (tmp_path / "a folder" / "x+y %z").write_bytes(b"")
    want["x+y %z"] = want["0"]
    files = documents.listed(spark, str(tmp_path))
    assert {r.uri.rpartition("/")[2]: r.digest for r in digests.file_digests(spark, files, "md5", chunk).collect()} == want


def log_of(spark, path, **how):
    return commits.CommitLog(spark, f"file://{path}", **how)


def test_writers_that_compete_leave_each_batch_once(spark, tmp_path):
    errors = []

    def write(name):
        try:
            log = log_of(spark, tmp_path, snapshot_every=3)
            for batch in range(4):
                for _ in range(2):
                    log.append(name, batch, spark.range(batch * 10, batch * 10 + 10).withColumn("who", F.lit(name)))
        except Exception as e:  # noqa: BLE001 - shown below
            errors.append(e)

    # Two of them have the same name: they try the same batches.
    threads = [threading.Thread(target=write, args=(n,)) for n in ("a", "b", "a")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert not errors
    rows = [(r.who, r.id) for r in log_of(spark, tmp_path).read("id long, who string").collect()]
    assert sorted(rows) == sorted((w, i) for w in "ab" for i in range(40))
    assert log_of(spark, tmp_path).state()["last"] == {"a": 3, "b": 3}


def test_a_killed_writer_is_not_seen(spark, tmp_path, monkeypatch):
    log = log_of(spark, tmp_path)
    assert log.state() == {"version": -1, "folders": [], "last": {}} and log.read("id long").count() == 0
    monkeypatch.setattr(commits.CommitLog, "_publish", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):
        log.append("w", 0, spark.range(5))
    monkeypatch.undo()
    assert log.read("id long").count() == 0
    assert log.append("w", 0, spark.range(5)) and not log.append("w", 0, spark.range(9)) and log.read("id long").count() == 5
    assert log.append("w", 7, spark.range(2)) and not log.append("w", 3, spark.range(2))


def test_compaction_and_readers_of_old_states(spark, tmp_path):
    log = log_of(spark, tmp_path, snapshot_every=1000)
    for k in range(3):
        log.append("w", k, spark.range(k, k + 2))
    before = log.state()
    assert log.snapshot(log.read("id long").distinct(), before)
    assert not log.snapshot(log.read("id long"), before)
    after = log.state()
    assert len(after["folders"]) == 1 and sorted(r.id for r in log.read("id long").collect()) == [0, 1, 2, 3]
    assert log.read("id long", before).count() == 6 and not log.append("w", 2, spark.range(1))


def test_routes_are_one_commit(spark, tmp_path):
    log = log_of(spark, tmp_path)
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "k int, ok boolean")
    assert commits.append_routed(log, "w", 0, df, F.col("ok")) and not commits.append_routed(log, "w", 0, df, F.col("ok"))
    assert sorted((r.k, r.route) for r in log.read("k int, ok boolean, route string").collect()) == [(1, "accepted"), (2, "rejected"), (3, "rejected")]
