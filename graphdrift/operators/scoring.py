"""The debt score of every snapshot's graph, its six components, and what explains them, under a scoring configuration.

All snapshots are computed at once. Degrees come from one pass over edges and modules; everything else is an aggregate per
snapshot over them, over the edges, or over the components of more than one module, which are few. Scores follow
100 * (1 - exp(-k * raw)); the total uses them unrounded, the debts are rounded to one decimal.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Scoring
from ..functions.labels import is_entry_stem
from ..functions.paths import globs_regex
from ..plans.runtime import cut, lookup

SNAPSHOT, MODULE = "snapshot_id", "module_name"
COMPONENTS = ("cycle", "layering", "hub", "coupling", "cognitive", "instability")


def curve(raw: Column, k: int) -> Column:
    return 100.0 * (1.0 - F.exp(-float(k) * raw))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def module_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(snapshot_id, module_name, fan_in, fan_out, weighted_degree) of every module, isolated ones too."""
    ends = F.array(
        F.struct(F.col("from_module").alias("m"), F.lit(0).alias("i"), F.lit(1).alias("o")),
        F.struct(F.col("to_module").alias("m"), F.lit(1).alias("i"), F.lit(0).alias("o")),
    )
    rows = edges.select(SNAPSHOT, F.explode(ends).alias("x"), F.col("weight").alias("w")).select(SNAPSHOT, F.col("x.m").alias(MODULE), "x.i", "x.o", "w")
    alone = nodes.select(SNAPSHOT, MODULE, F.lit(0).alias("i"), F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("w"))
    return (
        rows.unionByName(alone)
        .groupBy(SNAPSHOT, MODULE)
        .agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"), F.sum("w").cast("bigint").alias("weighted_degree"))
    )


def _named_like(module: Column, parts: list[str]) -> Column:
    return reduce(or_, (F.contains(module, F.lit(p)) for p in parts), F.lit(False))


def breaks_rule(cfg: Scoring) -> Column:
    """Whether an edge crosses a boundary that one of the rules denies."""
    denied = (F.col("from_module").rlike(globs_regex([r.from_glob])) & F.col("to_module").rlike(globs_regex(r.deny)) for r in cfg.boundaries)
    return reduce(or_, denied, F.lit(False))


def hub_flags(deg: DataFrame, cfg: Scoring) -> DataFrame:
    """deg (with `n`, the modules of the snapshot) and is_hub, hub_penalty: modules with many links in and out, in larger graphs."""
    t, total = cfg.thresholds, F.col("fan_in") + F.col("fan_out")
    least, ratio = F.greatest(F.lit(8.0), 2.0 * F.sqrt("n")), F.col("fan_out") / (F.col("fan_in") + 1.0)
    hub = (F.col("n") >= 6) & (total >= least) & (ratio >= t.hub_exemption_ratio) & (F.col("fan_in") > t.entry_point_max_fan_in)
    hub = hub & ~_named_like(F.col(MODULE), cfg.exemptions.hub_exempt)
    strength = clamp(F.col("weighted_degree") / F.greatest(total, F.lit(1)) / 2.0, 0.5, 2.0)
    return deg.withColumn("is_hub", hub).withColumn("hub_penalty", (total - least) / least * strength * F.least(ratio, F.lit(1.0)))


def brittle_flags(deg: DataFrame, cfg: Scoring) -> DataFrame:
    """deg with is_core (linked both ways enough to be judged) and is_brittle (depends on far more than depends on it)."""
    total = F.col("fan_in") + F.col("fan_out")
    core = (total >= 3) & (F.col("fan_in") > 0) & ~_named_like(F.col(MODULE), cfg.exemptions.instability_exempt)
    return deg.withColumn("is_core", core).withColumn("is_brittle", core & (F.col("fan_out") / total > cfg.thresholds.brittle_instability_ratio))


def judged_modules(deg: DataFrame, cfg: Scoring) -> DataFrame:
    """deg with n, is_entry, is_hub, hub_penalty, is_core and is_brittle."""
    sizes = deg.groupBy(SNAPSHOT).agg(F.count("*").alias("n"))
    stems = tuple(cfg.exemptions.entry_point_stems)
    entry = is_entry_stem(F.col(MODULE), stems) if stems else F.lit(False)
    return brittle_flags(hub_flags(deg.join(lookup(sizes), SNAPSHOT).withColumn("is_entry", entry), cfg), cfg)


def cyclic_components(scc: DataFrame) -> DataFrame:
    """(snapshot_id, scc_id, size) of the components with more than one module."""
    return scc.groupBy(SNAPSHOT, "scc_id").agg(F.count("*").alias("size")).where("size > 1")


def excess_edges(edges: DataFrame, scc: DataFrame, comps: DataFrame) -> DataFrame:
    """(snapshot_id, violations): edges inside components beyond those that a ring of their modules needs."""
    members = scc.join(comps, [SNAPSHOT, "scc_id"]).select(SNAPSHOT, MODULE, "scc_id", "size")
    a = members.select(SNAPSHOT, F.col(MODULE).alias("from_module"), F.col("scc_id").alias("ca"), "size")
    b = members.select(SNAPSHOT, F.col(MODULE).alias("to_module"), F.col("scc_id").alias("cb"))
    inside = edges.join(a, [SNAPSHOT, "from_module"]).join(b, [SNAPSHOT, "to_module"]).where("ca = cb")
    per = inside.groupBy(SNAPSHOT, "ca").agg(F.greatest(F.lit(0), F.count("*") - F.max("size")).alias("over"))
    return per.groupBy(SNAPSHOT).agg(F.sum("over").alias("violations"))


def measures(edges: DataFrame, nodes: DataFrame, scc: DataFrame, cfg: Scoring, deg: DataFrame | None = None) -> DataFrame:
    """One row per snapshot with modules: sizes, counts, and the unrounded score of each component."""
    deg = cut(module_degrees(edges, nodes)) if deg is None else deg
    per_module = judged_modules(deg, cfg).groupBy(SNAPSHOT).agg(
        F.max("n").alias("n"),
        F.count_if(F.expr("is_hub AND NOT is_entry")).alias("n_hubs"),
        F.sum(F.when(F.expr("is_hub AND NOT is_entry"), F.col("hub_penalty"))).alias("hub_sum"),
        F.count_if(F.expr("is_core AND NOT is_entry")).alias("n_core"),
        F.count_if(F.expr("is_brittle AND NOT is_entry")).alias("n_brittle"),
    )
    log_w = F.log1p(F.col("weight").cast("double"))
    per_edge = edges.groupBy(SNAPSHOT).agg(
        F.count("*").alias("e"), F.sum(log_w).alias("log_sum"), F.stddev_pop(log_w).alias("log_dev"), F.count_if(breaks_rule(cfg)).alias("boundary_violations")
    )
    comps = cut(cyclic_components(scc))
    cycles = comps.groupBy(SNAPSHOT).agg(F.count("*").alias("n_cycles"), F.sum("size").alias("n_cyclic"), F.max("size").alias("largest_cycle"))
    all_ = per_module.join(per_edge, SNAPSHOT, "left").join(cycles, SNAPSHOT, "left").join(excess_edges(edges, scc, comps), SNAPSHOT, "left")
    m = all_.fillna(0, ["e", "boundary_violations", "n_cycles", "n_cyclic", "largest_cycle", "violations"]).withColumn("log_mean", F.try_divide("log_sum", "e"))
    n, e = F.col("n").cast("double"), F.col("e").cast("double")
    linked = (F.col("n") >= 3) & (F.col("e") > 0)
    of_edges = lambda c: F.try_divide(F.col(c).cast("double"), e)
    cycle = 0.5 * F.col("n_cyclic") / n + 0.3 * F.col("largest_cycle") / n + 0.2 * F.least(F.lit(1.0), F.log1p(F.col("n_cycles").cast("double")) / F.log1p(n / 4.0))
    expected = 3.0 + 2.0 * F.log(n)
    tight = clamp((F.col("log_sum") / n - expected) / expected, 0.0, 1.0)
    spread = F.least(F.lit(1.0), F.coalesce(F.try_divide("log_dev", "log_mean"), F.lit(0.0)) / 2.0)
    more = clamp((e / (2.0 * n) - 1.0) / 2.0, 0.0, 1.0)
    denser = clamp(2.0 * e / n / F.greatest(F.lit(3.0), 2.0 * F.log(n)) - 1.0, 0.0, 1.0)
    hub = F.col("hub_sum") / F.col("n_hubs") * (1.0 + 0.3 * (F.col("n_hubs") - 1))
    brittle = F.try_divide(F.col("n_brittle").cast("double"), F.col("n_core").cast("double")) * (1.0 - F.exp(-n / 30.0))
    score = {
        "cycle": F.when(F.col("n_cycles") > 0, curve(cycle, 3)),
        "structural": F.when(linked, curve(of_edges("violations"), 3)),
        "boundary": F.when(F.col("e") > 0, curve(of_edges("boundary_violations"), 3)),
        "hub": F.when(F.col("n_hubs") > 0, curve(hub, 2)),
        "coupling": F.when(linked, curve(0.6 * tight + 0.4 * spread, 3)),
        "cognitive": F.when(F.col("n") >= 3, curve((0.5 * more + 0.5 * denser) * (1.0 - F.exp(-n / 20.0)), 3)),
        "instability": F.when((F.col("n") >= 3) & (F.col("n_core") > 0), curve(brittle, 3)),
    }
    m = m.select("*", *[F.coalesce(c, F.lit(0.0)).alias(k) for k, c in score.items()])
    # edges that exceed a ring are counted only in graphs that are judged for layers
    return m.withColumn("violations", F.when(linked, F.col("violations")).otherwise(F.lit(0))).withColumn("layering", F.greatest("structural", "boundary"))


def fan_deltas(deg: DataFrame, frames: DataFrame) -> DataFrame:
    """(snapshot_id, fan_in_delta, fan_out_delta): medians, cut to whole numbers, of the changes since the repository's previous
    frame over the modules that both have; 0 where there is none."""
    w = Window.partitionBy("repo_id").orderBy("scan_order", "commit_hash")
    links = cut(frames.select(SNAPSHOT, F.lag(SNAPSHOT).over(w).alias("previous")))
    before = deg.select(F.col(SNAPSHOT).alias("previous"), MODULE, F.col("fan_in").alias("in0"), F.col("fan_out").alias("out0"))
    both = deg.join(lookup(links.where("previous IS NOT NULL")), SNAPSHOT).join(before, ["previous", MODULE])
    half = lambda c: F.median(c).cast("int")
    found = both.groupBy(SNAPSHOT).agg(half(F.col("fan_in") - F.col("in0")).alias("fan_in_delta"), half(F.col("fan_out") - F.col("out0")).alias("fan_out_delta"))
    return links.select(SNAPSHOT).join(found, SNAPSHOT, "left").fillna(0)


def total_debt(cfg: Scoring) -> Column:
    w = cfg.normalized()
    return F.least(F.lit(100.0), F.round(sum((F.col(c) * w[c] for c in COMPONENTS), F.lit(0.0)))).cast("int")


def drift(edges: DataFrame, nodes: DataFrame, frames: DataFrame, scc: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """One row per frame: total debt, changes of fans, counts, the debt of each component, and the time of the frame.

    A frame without modules has zeros throughout.
    """
    cfg = cfg or Scoring()
    deg = cut(module_degrees(edges, nodes))
    m = measures(edges, nodes, scc, cfg, deg).select(
        SNAPSHOT, total_debt(cfg).alias("total"), F.col("n_cycles").alias("new_cycles"), "boundary_violations", F.col("violations").alias("layering_violations"),
        F.round("cognitive", 1).alias("cognitive_complexity"), *[F.round(c, 1).alias(f"{c}_debt") for c in COMPONENTS],
    )
    of_frames = frames.select(SNAPSHOT, F.col("frame_ts").alias("timestamp")).join(fan_deltas(deg, frames), SNAPSHOT)
    return of_frames.join(m, SNAPSHOT, "left").fillna(0, [c for c in m.columns if c != SNAPSHOT])


def _rule(df: DataFrame, rule: str, *args: Column, rank: Column | None = None) -> DataFrame:
    text = F.concat_ws(" ", *[a.cast("string") for a in args])
    return df.select(SNAPSHOT, F.lit(rule).alias("rule_id"), (F.lit(1) if rank is None else rank).cast("int").alias("rank"), text.alias("args"))


def diagnostics(edges: DataFrame, nodes: DataFrame, scc: DataFrame, cfg: Scoring | None = None) -> DataFrame:
    """(snapshot_id, rule_id, rank, args): why components are high; args are the numbers and names of the advice, by blanks.

    Equal hubs, links and fragile modules are ordered by name.
    """
    cfg = cfg or Scoring()
    deg = cut(module_degrees(edges, nodes))
    m = cut(measures(edges, nodes, scc, cfg, deg))
    high = {c: m.where(F.round(c, 1) > 10.0) for c in COMPONENTS}
    judged = judged_modules(deg, cfg)
    by_degree = Window.partitionBy(SNAPSHOT).orderBy((F.col("fan_in") + F.col("fan_out")).desc(), MODULE)
    hubs = judged.where("is_hub").withColumn("r", F.row_number().over(by_degree)).where("r <= 2")
    heaviest = edges.groupBy(SNAPSHOT).agg(F.min_by(F.struct("from_module", "to_module", "weight"), F.struct(-F.col("weight"), "from_module", "to_module")).alias("x"))
    expected = F.col("log_sum") / F.col("n") / (3.0 + 2.0 * F.log("n"))
    percent = F.round((F.col("e") / (2.0 * F.col("n")) - 1.0) * 100.0).cast("int")
    fragile = judged.where("is_core").groupBy(SNAPSHOT).agg(
        F.count("*").alias("eligible"), F.array_sort(F.collect_list(F.when(F.expr("is_brittle AND NOT is_entry"), F.col(MODULE)))).alias("names")
    )
    fragile = high["instability"].select(SNAPSHOT).join(fragile, SNAPSHOT).withColumn("k", F.size("names"))
    parts = [
        _rule(high["cycle"].where("n_cycles = 1"), "one_cycle", F.col("n_cyclic")),
        _rule(high["cycle"].where("n_cycles > 1"), "cycles", F.col("n_cycles"), F.col("n_cyclic"), F.col("largest_cycle")),
        _rule(high["layering"].where("violations > 0"), "layering", F.col("violations")),
        _rule(m.where("boundary_violations > 0"), "boundary", F.col("boundary_violations")),
        _rule(hubs.join(high["hub"].select(SNAPSHOT), SNAPSHOT), "hub", F.col(MODULE), F.col("fan_in"), F.col("fan_out"), rank=F.col("r")),
        _rule(high["coupling"].where(expected > 1.5), "tight", F.format_string("%.1f", expected)),
        _rule(high["coupling"].where(~(expected > 1.5)), "coupling"),
        _rule(high["coupling"].select(SNAPSHOT).join(heaviest, SNAPSHOT).where("x.weight > 5"), "heaviest", F.col("x.from_module"), F.col("x.to_module"), F.col("x.weight")),
        _rule(high["cognitive"].where(percent > 0), "cognitive", percent),
        _rule(fragile.where("k BETWEEN 1 AND 3"), "fragile", F.concat_ws(", ", "names")),
        _rule(fragile.where("k > 3"), "fragile_many", F.col("k"), F.col("eligible")),
    ]
    return reduce(DataFrame.unionByName, parts)


def boundary_list(edges: DataFrame, cfg: Scoring, shown: int = 10) -> DataFrame:
    """(snapshot_id, rank, from_module, to_module, n_found): the first crossings of boundaries in order of names, and how many
    there are in all."""
    w = Window.partitionBy(SNAPSHOT)
    found = edges.where(breaks_rule(cfg)).select(SNAPSHOT, "from_module", "to_module")
    ranked = found.withColumn("rank", F.row_number().over(w.orderBy("from_module", "to_module"))).withColumn("n_found", F.count("*").over(w))
    return ranked.where(F.col("rank") <= shown).select(SNAPSHOT, "rank", "from_module", "to_module", "n_found")
