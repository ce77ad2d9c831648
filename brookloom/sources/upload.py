"""Gated upload as a sink: what may go out is sent in batches, each address once, and all of a job or nothing.

A request (share, url, html, server, and what else goes with it) is refused for the first reason that holds: those of
``upload_verdict``, "sent before" where the table of sent addresses has its address, and "repeated" where an earlier request
of the same run has it. What is left goes to the data source ``gated_upload``. Its tasks stage batches; the commit moves those of
the attempts that Spark kept to the folder of sent batches, which is the table of sent addresses too, and an abort takes
the job's staged batches away. A run that broke off in its commit leaves each batch sent or unsent, so a repeated run sends
what is missing and nothing twice.

``path`` is a folder that driver and executors share as a file system. A program beside Spark may post the batches from there,
or a subclass of ``Upload`` sends them itself. Defined results: null or empty addresses are refused as "no address"; of repeated
addresses the request with the least html goes; other columns travel along; an empty table sends nothing.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from brookloom.functions.text import upload_verdict

BATCH, STAGED, SENT = 50, "_staged", "batches"


@dataclass
class Staged(WriterCommitMessage):
    files: list[str]
    rows: int


class Upload(DataSourceWriter):
    """Stages rows as files of one JSON object a line, ``batch`` rows each."""

    def __init__(self, path: str, batch: int):
        self.path, self.batch = path, batch
        self.own = os.path.join(path, STAGED, uuid.uuid4().hex)

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, rows, held = [], 0, []
        for row in iterator:
            held.append(row)
            rows += 1
            if len(held) == self.batch:
                files.append(self.stage(held))
                held = []
        if held:
            files.append(self.stage(held))
        return Staged(files, rows)

    def stage(self, rows: list[Row]) -> str:
        os.makedirs(self.own, exist_ok=True)
        name = f"{uuid.uuid4().hex}.json"
        with open(os.path.join(self.own, name), "w", encoding="utf-8") as f:
            f.writelines(json.dumps(r.asDict(True), ensure_ascii=False, default=str) + "\n" for r in rows)
        return name

    def commit(self, messages: list[Staged | None]) -> None:
        sent = os.path.join(self.path, SENT)
        os.makedirs(sent, exist_ok=True)
        for m in messages:
            for name in m.files if m else ():
                os.replace(os.path.join(self.own, name), os.path.join(sent, name))
        self.abort(messages)  # what attempts that don't count have staged

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.own, ignore_errors=True)


class GatedUpload(DataSource):
    """``df.write.format("gated_upload").option("path", ...).mode("append")``; ``batch``: rows of a batch."""

    @classmethod
    def name(cls) -> str:
        return "gated_upload"

    def writer(self, schema: object, overwrite: bool) -> Upload:
        if overwrite:
            raise ValueError("what is sent can't be overwritten; use mode append")
        return Upload(self.options["path"], int(self.options.get("batch", BATCH)))


def sent_addresses(spark: SparkSession, path: str) -> DataFrame:
    """url of everything that was sent."""
    folder = os.path.join(path, SENT)
    if not os.path.isdir(folder):
        return spark.createDataFrame([], "url string")
    return spark.read.schema("url string").json(folder).distinct()


def gated(requests: DataFrame, sent: DataFrame) -> DataFrame:
    """The requests with ``reason``, null for those that go."""
    nth = F.row_number().over(W.partitionBy("url", F.col("verdict").isNull()).orderBy("html"))
    verdict = F.coalesce(F.when(F.coalesce("url", F.lit("")) == "", "no address"), upload_verdict(F.col("share"), F.col("url"), F.col("html"), F.col("server")))
    judged = requests.withColumn("verdict", verdict)
    # Refused requests, which may share an address or have none, take no part in the windows and the join.
    refused = judged.where("verdict is not null").withColumn("reason", F.col("verdict"))
    open_ = judged.where("verdict is null").withColumn("nth", nth).join(sent.select("url").distinct().withColumn("before", F.lit(True)), "url", "left")
    reason = F.when(F.col("before"), "sent before").when(F.col("nth") > 1, "repeated")
    return open_.withColumn("reason", reason).select(*requests.columns, "reason").unionByName(refused.select(*requests.columns, "reason"))


def uploaded(requests: DataFrame, path: str, batch: int = BATCH) -> DataFrame:
    """Sends what may go, and returns the requests with their reasons as they stood before."""
    spark = requests.sparkSession
    spark.dataSource.register(GatedUpload)
    judged = gated(requests, sent_addresses(spark, path)).persist()
    judged.where("reason is null").drop("reason", "share", "server").write.format("gated_upload").option("path", path).option("batch", batch).mode("append").save()
    return judged
