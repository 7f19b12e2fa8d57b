"""The stage chain of recordings: one Parquet table a stage, one status a recording and stage.

A stage works on the recordings that the stage before it left whole. Kernels turn a failure into a row of its recording
(``operators.guard``), so one recording that fails leaves all others as they are. Statuses of a recording: ``failed``
(unusable input, nothing runs), ``no_rois`` (no unit is kept), ``partial`` (a stage failed), ``done``; of a stage: ``ok``,
``failed`` with a message, or ``skipped`` after a failure it depends on, without kept units, or with too few units:
clusters and correlations take two. Each recording's rate is a column, so any number of rates shares a stage's job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.kernels.events import DEFAULT, EventParams
from tracelake.operators import events, guard, traces
from tracelake.operators.records import in_windows, onset_source

#: Stages and what each of them reads.
NEEDS = {"traces": (), "onsets": ("traces",), "events": ("onsets",), "activation": ("events",), "clusters": ("traces",), "xcorr": ("clusters",)}
TWO_UNITS = ("clusters", "xcorr")


def checked(recordings: DataFrame, rois: DataFrame) -> DataFrame:
    """(rec_id, fps, n_frames, n_rois, status): unusable are rates that are not positive and traces of unequal length."""
    kept = rois.where("keep").groupBy("rec_id").agg(F.count("*").alias("n_rois"), F.min(F.size("f")).alias("a"), F.max(F.size("f")).alias("b"), F.min(F.size("fneu")).alias("c"), F.max(F.size("fneu")).alias("d"))
    out = recordings.select("rec_id", "fps").join(kept, "rec_id", "left")
    bad = F.expr("fps is null or not fps > 0 or (n_rois > 0 and (a != b or c != a or d != a or a <= 0))")
    status = F.when(F.col("n_rois").isNull(), "no_rois").when(bad, "failed").otherwise("done")
    return out.select("rec_id", "fps", F.coalesce("b", F.lit(0)).alias("n_frames"), F.coalesce("n_rois", F.lit(0)).alias("n_rois"), status.alias("status"))


def rate_onsets(rates: DataFrame, threshold: float) -> DataFrame:
    """(rec_id, roi_id, fps, spks) to onsets where a rate rises above the threshold."""
    long = rates.select("rec_id", "roi_id", "fps", F.posexplode("spks").alias("frame", "rate"))
    found = onset_source(long, long, "rates", threshold).join(rates.select("rec_id", "roi_id", "fps"), ["rec_id", "roi_id"])
    return found.select("rec_id", "roi_id", F.col("frame").alias("onset_frame"), (F.col("frame") / F.col("fps")).alias("onset_s"), F.lit(None).cast("string").alias("error"))


def run(recordings: DataFrame, rois: DataFrame, out: str, params: EventParams = DEFAULT, shuffles: int = 500, source: str = "derivative", threshold: float = 0.0) -> DataFrame:
    """``recordings``: (rec_id, fps); ``rois``: (rec_id, roi_id, f, fneu, keep), and spks where ``source`` is 'rates'.

    Tables go below ``out``: checked, one for each stage, ``<stage>-raw`` with the rows of failed groups, and ``stages``
    (rec_id, stage, status, message). What comes back is (rec_id, fps, n_frames, n_rois, status, n_failed, messages).
    """
    spark = recordings.sparkSession
    if source not in ("derivative", "rates"):
        raise ValueError(f"no onset source {source!r}")

    def keep(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    info = keep("checked", checked(recordings, rois))
    good = info.where("status = 'done'").select("rec_id", "fps", "n_frames", "n_rois")
    failed: dict[str, DataFrame] = {}

    def stage(name: str, rows: DataFrame) -> DataFrame:
        """Rows of recordings that the stage left whole."""
        raw = keep(f"{name}-raw", rows)
        failed[name] = keep(f"{name}-failed", guard.failures(raw, ["rec_id"]).select("rec_id", F.lit(name).alias("stage"), "message"))
        return keep(name, guard.results(raw).join(failed[name].select("rec_id"), "rec_id", "left_anti"))

    units = rois.where("keep").join(good.select("rec_id", "fps"), "rec_id")
    rate = good.select("rec_id", "fps")
    done = stage("traces", traces.process_traces(units, "fps", guard=True)).join(rate, "rec_id")
    if source == "rates":
        found = rate_onsets(units.join(failed["traces"], "rec_id", "left_anti"), threshold)
    else:
        found = events.onset_frames(done, "fps", guard=True)
    onsets = stage("onsets", found)
    length = good.select("rec_id", (F.col("n_frames") / F.col("fps")).alias("duration_s"), "n_rois")
    windows = stage("events", events.detect_events(onsets, length, params, guard=True))
    hits = in_windows(onsets.select("rec_id", "roi_id", F.col("onset_s").alias("t")), windows.select("rec_id", "event_id", "start_s", "end_s"), cell=5.0)
    active = hits.groupBy("rec_id", "event_id", "roi_id").agg(F.min("t").alias("first_time_s"))
    stage("activation", active.withColumn("error", F.lit(None).cast("string")))
    groups = stage("clusters", traces.clusters(done, guard=True))
    stage("xcorr", events.cluster_correlation(done, groups, "fps", shuffles=shuffles, guard=True))
    return _fold(info, failed, keep)


def _fold(info: DataFrame, failed: dict[str, DataFrame], keep) -> DataFrame:
    """Statuses of stages, each from its own failures and those of what it reads; then of recordings."""
    whole = None
    for part in failed.values():
        whole = part if whole is None else whole.unionByName(part)
    above = {name: {name} for name in NEEDS}
    for name, needs in NEEDS.items():
        for need in needs:
            above[name] |= above[need]
    reach = [(name, other) for name, others in above.items() for other in others]
    every = info.sparkSession.createDataFrame(reach, "stage string, source string")  # one row for each stage and what it rests on
    gone = whole.withColumnRenamed("stage", "source").join(F.broadcast(every), "source")
    gone = gone.groupBy("rec_id", "stage").agg(F.max(F.when(F.col("source") == F.col("stage"), F.col("message"))).alias("message"), F.lit(True).alias("hit"))
    grid = info.select("rec_id", "status", "n_rois", F.explode(F.array(*map(F.lit, NEEDS))).alias("stage"))
    few = F.col("stage").isin(*TWO_UNITS) & (F.col("n_rois") < 2)
    state = F.when(F.col("status") != "done", "skipped").when(F.col("message").isNotNull(), "failed").when(F.col("hit") | few, "skipped").otherwise("ok")
    stages = grid.join(gone, ["rec_id", "stage"], "left").select("rec_id", "stage", state.alias("status"), "message")
    stages = keep("stages", stages)
    bad = stages.where("status = 'failed'").groupBy("rec_id").agg(F.count("*").alias("n_failed"), F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "stage", "message"))), "; ").alias("messages"))
    out = info.join(bad, "rec_id", "left").fillna(0, ["n_failed"])
    return out.withColumn("status", F.when((F.col("status") == "done") & (F.col("n_failed") > 0), "partial").otherwise(F.col("status")))
