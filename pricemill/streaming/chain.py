"""Hash-chained ledger of a stream: parallel lanes under one anchored root.

A chain is serial, so a source has several lanes, each with its own chain: one source holding most of the records still spreads over that many
tasks. After each trigger the tips of all lanes are digested into one root, and the anchor of the trigger chains that root to the anchor
before it. So a single hash vouches for the whole ledger: lanes show changed, removed and reordered records, and the anchors show
a lane that lost its end, or a lane that is gone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.digests import merkle_root
from ..operators.ledger import GENESIS, check_links
from ..session import materialise
from ..sources.quotes import path_exists

LANE = ["source", "lane"]
TIP = "source string, lane long, seq long, tip string, epoch long"
ANCHOR = "epoch long, prev_anchor string, root string, n_lanes long, n_records long, anchor string"
RECORD = "source string, lane long, seq long, event_id long, body string, prev_hash string, this_hash string"


def _linked(batches):
    """Records in order of (source, lane, event_id), each with the lane's start, linked one by one."""
    lane = seq = tip = None
    for batch in batches:
        cols = {c: batch.column(c).to_pylist() for c in ("source", "lane", "body", "seq", "tip")}
        seqs, before, after = [], [], []
        for source, number, body, start, first in zip(*cols.values()):
            if (source, number) != lane:
                lane, seq, tip = (source, number), start, first
            seq += 1
            this = hashlib.sha256((tip + body).encode()).hexdigest()
            seqs.append(seq), before.append(tip), after.append(this)
            tip = this
        yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("lane"), pa.array(seqs, pa.int64()), batch.column("event_id"), batch.column("body"),
                                          pa.array(before, pa.string()), pa.array(after, pa.string())], [c.split(" ")[0] for c in RECORD.split(", ")])


def line() -> Column:
    return F.concat_ws("|", "source", F.col("lane").cast("string"), F.col("seq").cast("string"), "tip")


def _before(spark: SparkSession, path: str, kind: str, epoch: int, schema: str) -> DataFrame:
    """What the newest trigger before ``epoch`` wrote of ``kind``."""
    if not path_exists(spark, f"{path}/{kind}"):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{path}/{kind}").where(F.col("epoch") < epoch)
    newest = found.agg(F.max("epoch")).first()[0]
    return found.where(F.col("epoch") == newest) if newest is not None else found


def chain_sink(path: str, lanes: int) -> Callable[[DataFrame, int], None]:
    """Append each record (source, event_id, body) to the chain of its lane, in order of event_id within a trigger.

    ``lanes`` belongs to the ledger: it is chosen when the ledger is begun and must stay the same, since the lane of a record is a hash of
    its id. Each trigger writes folders of its own, so a replayed trigger leaves one copy. A null body is the empty text.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        tips = _before(spark, path, "tips", epoch, TIP).drop("epoch")
        laned = batch.select("source", F.col("event_id").cast("long").alias("event_id"), F.coalesce("body", F.lit("")).alias("body")).withColumn(
            "lane", F.conv(F.substring(F.md5(F.coalesce(F.col("event_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long") % lanes)
        started = laned.join(tips, [laned.source.eqNullSafe(tips.source), laned.lane == tips.lane], "left").select(
            laned.source, laned.lane, "event_id", "body", F.coalesce("seq", F.lit(0).cast("long")).alias("seq"), F.coalesce("tip", F.lit(GENESIS)).alias("tip"))
        ordered = started.repartition(*LANE).sortWithinPartitions(*LANE, "event_id", "body")
        ordered.mapInArrow(_linked, RECORD).write.mode("overwrite").parquet(f"{path}/records/epoch={epoch}")
        new = spark.read.schema(RECORD).parquet(f"{path}/records/epoch={epoch}")
        ends = new.select(*LANE, "seq", F.col("this_hash").alias("tip")).unionByName(tips)
        now = ends.groupBy(*LANE).agg(F.max(F.struct("seq", "tip")).alias("_t")).select(*LANE, "_t.*").withColumn("epoch", F.lit(epoch).cast("long"))
        now.write.mode("overwrite").parquet(f"{path}/tips/epoch_{epoch}")
        held = spark.read.schema(TIP).parquet(f"{path}/tips/epoch_{epoch}")
        root = merkle_root(held, line()).first()
        last = _before(spark, path, "anchors", epoch, ANCHOR).first()
        prev = last["anchor"] if last else GENESIS
        total = held.agg(F.coalesce(F.sum("seq"), F.lit(0))).first()[0]
        anchor = hashlib.sha256((prev + root["root"]).encode()).hexdigest()
        spark.createDataFrame([(epoch, prev, root["root"], root["n"], total, anchor)], ANCHOR).write.mode("overwrite").parquet(f"{path}/anchors/epoch_{epoch}")
    return write


def records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD + ", epoch long").parquet(f"{path}/records")


def anchors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANCHOR).option("recursiveFileLookup", "true").parquet(f"{path}/anchors")


def verify(spark: SparkSession, path: str, per_bucket: int = 100_000) -> DataFrame:
    """(epoch, source, lane, seq, fault) for everything that doesn't hold; no row for a sound ledger.

    Links are checked record by record; then the tips of every trigger are derived from the records and digested again.
    """
    held = materialise(records(spark, path), "ledger")
    broken = check_links(held, F.col("body"), LANE, per_bucket).where("is_broken").select("epoch", *LANE, "seq", F.lit("broken link").alias("fault"))
    written = anchors(spark, path).orderBy("epoch").collect()  # one row per trigger
    faults, prev = [], GENESIS
    for row in written:
        upto = held.where(F.col("epoch") <= row["epoch"]).groupBy(*LANE).agg(F.max(F.struct("seq", F.col("this_hash").alias("tip"))).alias("_t")).select(*LANE, "_t.*")
        root = merkle_root(upto, line()).first()
        if row["root"] != root["root"] or row["n_lanes"] != root["n"]:
            faults.append((row["epoch"], None, None, None, "root differs"))
        if row["prev_anchor"] != prev or row["anchor"] != hashlib.sha256((prev + row["root"]).encode()).hexdigest():
            faults.append((row["epoch"], None, None, None, "broken anchor"))
        prev = row["anchor"]
    return broken.unionByName(spark.createDataFrame(faults, "epoch long, source string, lane long, seq long, fault string"))
