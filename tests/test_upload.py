"""Uploads: reasons, batches, a job that breaks off, and runs again."""

from __future__ import annotations

import json
import os

import pytest

from brookloom.sources.upload import BATCH, SENT, STAGED, GatedUpload, Upload, gated, sent_addresses, uploaded

SCHEMA = "share boolean, url string, html string, server string, page_id int"
ROWS = [(True, f"https://a.example.com/{i}", f"<p>{i}", "https://s", i) for i in range(130)]
ODD = [
    (False, "https://x.example.com", "<p>", "https://s", 200), (True, "http://localhost/a", "<p>", "https://s", 201), (True, "https://y.example.com", "<p>", "", 202),
    (None, "https://z.example.com", "<p>", "https://s", 203), (True, None, "<p>", "https://s", 204), (True, "https://a.example.com/1", "<p>longer", "https://s", 205),
    (True, "https://b.example.com", None, "https://s", 206), (True, "", "", "https://s", 207),
]


def lines(path):
    folder = os.path.join(path, SENT)
    found = [[json.loads(x) for x in open(os.path.join(folder, f), encoding="utf-8")] for f in os.listdir(folder)] if os.path.isdir(folder) else []
    return found


def test_batches_and_reasons(spark, tmp_path):
    path = str(tmp_path)
    requests = spark.createDataFrame(ROWS + ODD, SCHEMA).repartition(3)
    got = {r.page_id: r.reason for r in uploaded(requests, path, 20).collect()}
    assert [got[k] for k in range(200, 208)] == ["not shared", "private url", "no server", "not shared", "no address", "repeated", None, "no address"]
    found = lines(path)
    sent = [x["url"] for b in found for x in b]
    assert len(sent) == len(set(sent)) == 131 and max(map(len, found)) == 20 and set(found[0][0]) == {"url", "html", "page_id"}
    assert {r.url for r in sent_addresses(spark, path).collect()} == set(sent)
    # A repeated run sends nothing; a run with one more address sends that.
    more = spark.createDataFrame([*ROWS, (True, "https://new.example.com", "<p>", "https://s", 300)], SCHEMA)
    again = {r.page_id: r.reason for r in uploaded(more, path).collect()}
    assert again[300] is None and again[0] == "sent before"
    assert sorted(x["url"] for b in lines(path) for x in b) == sorted([*sent, "https://new.example.com"])


def test_a_job_that_fails_sends_nothing(spark, tmp_path):
    path = str(tmp_path)
    spark.dataSource.register(GatedUpload)

    def fails(batches):
        for n, batch in enumerate(batches):
            yield batch
        raise ValueError("a task breaks off")

    df = spark.createDataFrame(ROWS, SCHEMA).repartition(2)
    with pytest.raises(Exception, match="breaks off"):
        df.mapInArrow(fails, SCHEMA).write.format("gated_upload").option("path", path).option("batch", 1).mode("append").save()
    staged = os.path.join(path, STAGED)
    assert lines(path) == [] and not (os.path.isdir(staged) and os.listdir(staged))
    uploaded(df, path)
    assert sum(map(len, lines(path))) == 130


def test_a_commit_that_breaks_off_is_made_good(spark, tmp_path):
    """Of two staged batches one was moved: the next run sends the other, and nothing twice."""
    path, requests = str(tmp_path), spark.createDataFrame(ROWS[:8], SCHEMA)
    half = Upload(path, 4)
    done = half.write(iter(requests.drop("share", "server").collect()))
    assert done.rows == 8 and len(done.files) == 2
    os.makedirs(os.path.join(path, SENT))
    os.replace(os.path.join(half.own, done.files[0]), os.path.join(path, SENT, done.files[0]))
    reasons = [r.reason for r in gated(requests, sent_addresses(spark, path)).collect()]
    assert reasons.count("sent before") == reasons.count(None) == 4
    uploaded(requests, path)
    sent = [x["url"] for b in lines(path) for x in b]
    assert sorted(sent) == sorted(r[1] for r in ROWS[:8]) and BATCH == 50


def test_abort_takes_staged_batches_away(tmp_path):
    from pyspark.sql import Row

    own = Upload(str(tmp_path), 2)
    messages = [own.write(iter([Row(url="a"), Row(url="b"), Row(url="c")]))]
    assert len(os.listdir(own.own)) == 2
    own.abort(messages)
    assert not os.path.exists(own.own) and lines(str(tmp_path)) == []


def test_attempts_that_do_not_count(tmp_path):
    from pyspark.sql import Row

    own = Upload(str(tmp_path), 2)
    own.write(iter([Row(url="lost")]))
    own.commit([own.write(iter([Row(url="kept")])), None])
    assert [x["url"] for b in lines(str(tmp_path)) for x in b] == ["kept"]


def test_empty(spark, tmp_path):
    assert uploaded(spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0 and lines(str(tmp_path)) == []
