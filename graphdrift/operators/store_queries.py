"""Store queries over commits and frames, all repositories at once.

Functions take the frames and the commit rows of a store (one row each) and give one DataFrame. Lists are newest first by
scan_order, equal ones by hash, and cut per repository by the feature's own top-k. Earlier frames are reached by offsets
within an ordered window, so no frame is joined with another. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIST_LIMIT, TREND_LIMIT, PREVIOUS_LIMIT, SAMPLES, TREND_SHOWN, PAGE = 10, 20, 3, 20, 50, 10
ANALYSIS_VERSION, NO_TOTAL, CHECKPOINT_EVERY = 3, 50, 20
DEBTS = ("cycle", "layering", "hub", "coupling", "cognitive", "instability")


def _by(*order: str, newest_first: bool = False):
    """The window of a repository's rows in an order."""
    return Window.partitionBy("repo_id").orderBy(*[F.col(c).desc() if newest_first else F.col(c) for c in order])


def _frames():
    return _by("scan_order", "commit_hash")


def _newest():
    return _by("scan_order", "commit_hash", newest_first=True)


def _repo():
    return Window.partitionBy("repo_id")


def newest(frames: DataFrame, k: int) -> DataFrame:
    """The k newest frames of each repository, with their position `rn` from 1."""
    return frames.withColumn("rn", F.row_number().over(_newest())).where(F.col("rn") <= k)


def with_commit(frames: DataFrame, commits: DataFrame, *cols: str) -> DataFrame:
    return frames.join(commits.select("repo_id", F.col("hash").alias("commit_hash"), *cols), ["repo_id", "commit_hash"])


def list_graphs(f: DataFrame, c: DataFrame) -> DataFrame:
    shown = newest(with_commit(f, c, "author_name", "message"), LIST_LIMIT)
    return shown.select("repo_id", "commit_hash", "scan_order", "node_count", "edge_count", "author_name", "message", "frame_ts")


def drift_trend(f: DataFrame, c: DataFrame) -> DataFrame:
    shown = newest(with_commit(f.select("repo_id", "commit_hash", "scan_order", "total"), c), TREND_LIMIT)
    return shown.select("repo_id", "commit_hash", "scan_order", "total", (F.col("total") - F.lag("total").over(_frames())).alias("delta"))


def previous_snapshot(f: DataFrame, c: DataFrame) -> DataFrame:
    before = [F.lag(x).over(_frames()).alias(n) for x, n in (("commit_hash", "previous_hash"), ("scan_order", "previous_order"))]
    return f.select("repo_id", "commit_hash", "scan_order", *before)


def _offsets(f: DataFrame, steps: range, *cols: str) -> DataFrame:
    """Each frame once for every step back that exists, with `step` and the columns `then_...` of the earlier frame."""
    back = F.array(*[F.struct(F.lit(i).alias("step"), *[F.lag(c, i).over(_frames()).alias(f"then_{c}") for c in cols]) for i in steps])
    each = f.withColumn("back", back).withColumn("x", F.explode("back"))
    return each.select("*", "x.*").where("then_commit_hash IS NOT NULL").drop("x", "back")


def previous_drift(f: DataFrame, c: DataFrame) -> DataFrame:
    rows = _offsets(f.select("repo_id", "commit_hash", "scan_order", "total"), range(1, PREVIOUS_LIMIT + 1), "commit_hash", "total")
    return rows.select("repo_id", "commit_hash", F.col("then_commit_hash").alias("previous_hash"), F.col("step").alias("steps_back"), (F.col("total") - F.col("then_total")).alias("total_change"))


def trend(f: DataFrame, c: DataFrame) -> DataFrame:
    """For each frame the last TREND_SHOWN frames up to it: a ROWS window collects them, so none is joined."""
    w = _frames().rowsBetween(1 - TREND_SHOWN, Window.currentRow)
    place = F.row_number().over(_frames())
    numbered = f.select("repo_id", "commit_hash", "scan_order", "total", place.alias("position"))
    item = F.struct(F.col("commit_hash").alias("shown_hash"), "position", F.coalesce("total", F.lit(NO_TOTAL)).alias("total"))
    shown = numbered.select("repo_id", "commit_hash", F.collect_list(item).over(w).alias("shown"))
    return shown.select("repo_id", "commit_hash", F.explode("shown").alias("x")).select("repo_id", "commit_hash", "x.*")


def sampled_meta(f: DataFrame, c: DataFrame) -> DataFrame:
    """SAMPLES frames spread evenly over the repository's frames: of every step the first frame that it reaches."""
    pos, n = F.row_number().over(_newest()) - 1, F.count("*").over(_repo())
    at = f.select("repo_id", "commit_hash", "scan_order", pos.alias("pos"), n.alias("n"))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda i: F.floor(i * (F.col("n") - 1) / F.lit(float(SAMPLES - 1))))
    return at.where((F.col("n") <= SAMPLES) | F.array_contains(wanted, F.col("pos").cast("bigint"))).select("repo_id", "commit_hash", "scan_order")


def counts(f: DataFrame, c: DataFrame) -> DataFrame:
    both = c.select("repo_id", F.lit(1).alias("c"), F.lit(0).alias("f")).unionByName(f.select("repo_id", F.lit(0).alias("c"), F.lit(1).alias("f")))
    return both.groupBy("repo_id").agg(F.sum("c").alias("n_commits"), F.sum("f").alias("n_frames")).where("n_commits > 0")


def checkpoint_artifacts(f: DataFrame, c: DataFrame) -> DataFrame:
    last = F.last(F.when(F.col("has_full_artifacts"), F.col("scan_order")), ignorenulls=True)
    w = Window.partitionBy("repo_id").orderBy("scan_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return f.select("repo_id", "commit_hash", "scan_order", last.over(w).alias("artifacts_order"))


def needs_core() -> Column:
    """Whether a stored analysis is older than the engine, or lacks its fingerprint, its scan's numbers or its score."""
    old = (F.col("analysis_version") < ANALYSIS_VERSION) | (F.coalesce("config_fingerprint", F.lit("")) == "")
    return old | ~F.col("has_metadata") | ~F.col("has_drift")


def requires_recompute(f: DataFrame, c: DataFrame) -> DataFrame:
    return f.select("repo_id", "commit_hash", needs_core().alias("core"), (~F.coalesce("has_full_artifacts", F.lit(False))).alias("runtime_insights"))


def resolve_analysis(f: DataFrame, c: DataFrame) -> DataFrame:
    served = F.when(needs_core(), "core").when(F.coalesce("has_full_artifacts", F.lit(False)), "stored").otherwise("runtime")
    return f.select("repo_id", "commit_hash", served.alias("served"))


def trend_direction(f: DataFrame, c: DataFrame) -> DataFrame:
    now = F.coalesce("total", F.lit(NO_TOTAL))
    change = now - F.lag(now).over(_frames())
    return f.select("repo_id", "commit_hash", F.when(change < 0, "improving").when(change > 0, "degrading").otherwise("stable").alias("direction"))


def health_stats(f: DataFrame, c: DataFrame) -> DataFrame:
    h = F.greatest(F.lit(0), 100 - F.coalesce("total", F.lit(NO_TOTAL)))
    return f.groupBy("repo_id").agg(F.min(h).alias("least"), F.max(h).alias("most"), F.floor(F.sum(h) / F.count("*")).alias("mean"))


def timeline_seek(f: DataFrame, c: DataFrame) -> DataFrame:
    at = f.select("repo_id", "commit_hash", "scan_order", F.row_number().over(_newest()).alias("rn"), F.count("*").over(_repo()).alias("n"))
    to = lambda step: F.greatest(F.lit(1), F.least("n", F.col("rn") + step))
    return at.select("repo_id", "commit_hash", "scan_order", to(-1).alias("newer"), to(1).alias("older"), to(-PAGE).alias("jump_newer"), to(PAGE).alias("jump_older"))


def recommendations(f: DataFrame, c: DataFrame) -> DataFrame:
    """Advice from stored scores: components above 20, what a low total says, and 'none' where neither applies."""
    parts = [F.struct(F.lit(d).alias("rule_id"), F.col(f"{d}_debt").alias("score")) for d in DEBTS]
    total = F.col("total").cast("double")
    low = F.struct(F.when(F.col("total") <= 15, "total_low").otherwise("total_fair").alias("rule_id"), total.alias("score"))
    quiet = F.col("has_drift") & (F.col("total") > 30) & (F.greatest(*[f"{d}_debt" for d in DEBTS]) <= 20)
    rows = F.concat(F.filter(F.array(*parts), lambda x: x["score"] > 20), F.when(F.col("total") <= 30, F.array(low)).otherwise(F.array()), F.when(quiet, F.array(F.struct(F.lit("none").alias("rule_id"), total.alias("score")))).otherwise(F.array()))
    return f.select("repo_id", "commit_hash", F.explode(rows).alias("x")).select("repo_id", "commit_hash", "x.rule_id", "x.score")


def worst_component(f: DataFrame, c: DataFrame) -> DataFrame:
    """The component with the greatest debt; of equal ones the last in their order."""
    worst = F.array_max(F.array(*[F.struct(F.col(f"{d}_debt").alias("debt"), F.lit(i).alias("place"), F.lit(d).alias("name")) for i, d in enumerate(DEBTS)]))["name"]
    advice = F.when(F.col("total") <= 15, "great").when(F.col("total") <= 30, "healthy").when(F.col("total") <= 55, "attention").otherwise("urgent")
    return f.where("has_drift").select("repo_id", "commit_hash", "total", worst.alias("worst"), advice.alias("advice"))


def lineage(c: DataFrame) -> DataFrame:
    """Commits with `pos`, their place from the newest, and `n`, the number of the repository's commits."""
    return c.select("repo_id", "hash", F.row_number().over(_by("scan_order", "hash", newest_first=True)).alias("pos"), F.count("*").over(_repo()).alias("n"))


def scanned(f: DataFrame, c: DataFrame) -> DataFrame:
    """lineage with `stop`, the place of the repository's newest commit that has a frame (null where none has)."""
    known = f.select("repo_id", F.col("commit_hash").alias("hash"), F.lit(True).alias("known"))
    return lineage(c).join(known, ["repo_id", "hash"], "left").withColumn("stop", F.min(F.when(F.col("known"), F.col("pos"))).over(_repo()))


def plan_incremental(f: DataFrame, c: DataFrame) -> DataFrame:
    never = F.coalesce("stop", F.lit(10**9))
    base = F.max(F.when(F.col("pos") == F.least(never, F.lit(TREND_LIMIT + 1)), F.col("hash")))
    return scanned(f, c).groupBy("repo_id").agg(
        F.count_if((F.col("pos") < never) & (F.col("pos") <= TREND_LIMIT)).alias("n_new"),
        ((F.max(never) > TREND_LIMIT + 1) & (F.max("pos") > TREND_LIMIT)).alias("truncated"), F.max("stop").isNotNull().alias("reached_stop"), base.alias("baseline_hash"),
    )


def action(f: DataFrame, c: DataFrame) -> DataFrame:
    stop = F.col("stop")
    what = F.when(stop == 1, "skip").when(stop.isNull(), "rebuild_full").when(stop > TREND_LIMIT + 1, "rebuild_window").otherwise("append")
    return scanned(f, c).groupBy("repo_id").agg(F.max("stop").alias("stop")).select("repo_id", what.alias("action"))


def depth(f: DataFrame, c: DataFrame) -> DataFrame:
    return scanned(f, c).where("pos = 1").select("repo_id", F.when(F.col("known"), F.col("n")).alias("depth"))


def invalidate(f: DataFrame, c: DataFrame) -> DataFrame:
    """Whether a repository's store must be cleared: the newest frame is of an older engine or has another fingerprint than
    the first one."""
    first = F.first("config_fingerprint").over(_frames().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    old = (F.col("analysis_version") < ANALYSIS_VERSION) | (F.coalesce("config_fingerprint", F.lit("")) == "") | (F.col("config_fingerprint") != F.col("first"))
    return newest(f.withColumn("first", first), 1).select("repo_id", old.alias("clear_all"))


def checkpoints(f: DataFrame, c: DataFrame) -> DataFrame:
    """The frames whose whole state is stored: the first, every CHECKPOINT_EVERY-th and the last one of each repository."""
    at = f.withColumn("k", F.row_number().over(_frames())).withColumn("n", F.count("*").over(_repo()))
    return at.where(f"k = 1 OR k % {CHECKPOINT_EVERY} = 0 OR k = n").select("repo_id", "commit_hash", "scan_order")


def baseline(f: DataFrame, c: DataFrame) -> DataFrame:
    last = newest(f, 1).select("repo_id", F.col("commit_hash").alias("state_hash"))
    head = lineage(c).where("pos = 1").select("repo_id", "hash")
    return head.join(last, "repo_id").select("repo_id", (F.col("hash") == F.col("state_hash")).alias("reuse_state"), "state_hash")


def commit_meta(f: DataFrame, c: DataFrame) -> DataFrame:
    text = {"author_name": "unknown", "author_email": "unknown", "message": ""}
    return c.fillna(text).fillna({"commit_ts": 0}).select("repo_id", "hash", "author_name", "author_email", "commit_ts", "message", "tree_id")


OPS = {
    "q_list_graphs": list_graphs,
    "q_drift_trend": drift_trend,
    "q_latest_scanned": lambda f, c: newest(f, 1).select("repo_id", "commit_hash", "scan_order"),
    "q_scan_order": lambda f, c: f.select("repo_id", "commit_hash", "scan_order"),
    "q_snapshot_meta": lambda f, c: f.select("repo_id", "commit_hash", "scan_order", "frame_ts", "node_count", "edge_count", "analysis_version", "config_fingerprint", "has_full_artifacts", "total"),
    "q_previous_snapshot": previous_snapshot,
    "q_previous_drift": previous_drift,
    "q_recent_meta": lambda f, c: newest(f, SAMPLES).select("repo_id", "commit_hash", "scan_order", "node_count", "edge_count"),
    "q_sampled_meta": sampled_meta,
    "q_commit_messages": lambda f, c: with_commit(f.select("repo_id", "commit_hash"), c, "message"),
    "q_counts": counts,
    "q_checkpoint_artifacts": checkpoint_artifacts,
    "q_load_scan_state": lambda f, c: newest(f, 1).select("repo_id", F.col("commit_hash").alias("last_hash"), F.col("scan_order").alias("last_order"), "node_count", "edge_count"),
    "q_requires_recompute": requires_recompute,
    "rp_trend": trend,
    "rp_trend_direction": trend_direction,
    "rp_health_stats": health_stats,
    "rp_resolve_analysis": resolve_analysis,
    "rp_timeline_seek": timeline_seek,
    "sc_recommendations": recommendations,
    "sc_worst_component": worst_component,
    "src_commit_count": lambda f, c: c.groupBy("repo_id").agg(F.count("*").alias("n_commits")),
    "src_commits": lambda f, c: c.select("repo_id", "hash", F.row_number().over(_by("scan_order", "hash")).alias("lineage_order")),
    "src_commit_meta": commit_meta,
    "src_plan_incremental": plan_incremental,
    "src_commits_since": lambda f, c: scanned(f, c).where("pos < stop").select("repo_id", "hash", "pos"),
    "inc_action": action,
    "inc_depth": depth,
    "inc_invalidate": invalidate,
    "inc_detail": lambda f, c: f.select("repo_id", "commit_hash", (F.row_number().over(_newest()) == 1).alias("full_artifacts")),
    "inc_checkpoint": checkpoints,
    "inc_baseline": baseline,
}
