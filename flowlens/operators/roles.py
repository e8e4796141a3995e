"""Structural roles, priority for review, and cluster summaries: hypotheses for an analyst, not verdicts."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.functions.quantiles import exact_quantiles
from flowlens.functions.stats import rank_shares, transitions
from flowlens.operators.centrality import betweenness
from flowlens.operators.communities import communities
from flowlens.operators.fifo import timing
from flowlens.operators.flows import six, turnover
from flowlens.operators.paths import seed_reach
from flowlens.plans.shared import cut
from flowlens.sources.tables import Network

ROLES = ("coordinator", "distributor", "consolidator", "transit", "terminal")


@dataclass(frozen=True)
class RoleConfig:
    """Fixed values of the rules; weights sum to 1."""

    max_depth: int = 4
    random_seed: int = 42
    louvain_resolution: float = 1.0
    centrality_mode: str = "exact"
    betweenness_samples: int = 64
    consolidator_min_payers: int = 5
    consolidator_min_seeds: int = 2
    distributor_min_payees: int = 5
    distributor_fan_ratio: float = 2.0
    transit_ratio_min: float = 0.8
    transit_ratio_max: float = 1.2
    transit_window_days: int = 2
    transit_min_matched_fraction: float = 0.8
    coordinator_min_degree: int = 4
    coordinator_min_seeds: int = 3
    coordinator_min_other_clusters: int = 2
    coordinator_centrality_quantile: float = 0.9
    priority_weights: dict[str, float] = field(default_factory=lambda: {"seed_reach": 0.30, "flow": 0.25, "bridge": 0.20, "fan": 0.15, "role_support": 0.10})

    def __post_init__(self) -> None:
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and abs(v) < 1e300
        weights = self.priority_weights
        for f in fields(self):
            v = getattr(self, f.name)
            if f.type == "int" and not (isinstance(v, int) and number(v) and v >= 0) or f.type == "float" and not (number(v) and v >= 0):
                raise ValueError(f"{f.name}: not a valid number: {v!r}")
        if not isinstance(weights, dict) or set(weights) != set(PARTS) or not all(number(v) and v >= 0 for v in weights.values()) or abs(sum(weights.values()) - 1) > 1e-9:
            raise ValueError("priority_weights must name the five parts, not be negative and sum to 1")
        if self.centrality_mode not in ("exact", "approximate"):
            raise ValueError("centrality_mode must be exact or approximate")
        if self.max_depth != 4 or self.betweenness_samples < 1 or self.louvain_resolution <= 0:
            raise ValueError("max_depth must be 4, betweenness_samples at least 1, louvain_resolution above 0")
        if self.transit_ratio_min > self.transit_ratio_max or self.coordinator_centrality_quantile > 1 or not 0 < self.transit_min_matched_fraction <= 1:
            raise ValueError("bounds must be ordered, and fractions lie between 0 and 1")


def read_config(spark: SparkSession, path: str) -> RoleConfig:
    """The configuration in a JSON file on any file system Spark reads: exactly the keys of RoleConfig, checked values."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).limit(2).collect())  # one small file
    found = json.loads(text)
    if not isinstance(found, dict) or set(found) != {f.name for f in fields(RoleConfig)}:
        raise ValueError("a configuration is a JSON object with exactly the known parameters")
    return RoleConfig(**found)


PARTS = ("seed_reach", "flow", "bridge", "fan", "role_support")


def other_clusters(net: Network, clusters: DataFrame) -> DataFrame:
    """(gid, other_clusters): distinct clusters among a node's partners, less its own. clusters: (gid, cluster_id)."""
    both = net.links.select(F.col("src").alias("gid"), F.col("dst").alias("other")).unionByName(net.links.select(F.col("dst").alias("gid"), F.col("src").alias("other")))
    named = both.join(clusters.select(F.col("gid").alias("other"), F.col("cluster_id").alias("c")), "other").join(clusters, "gid").where("c <> cluster_id")
    found = named.groupBy("gid").agg(F.count_distinct("c").alias("other_clusters"))
    return net.nodes.select("gid").join(found, "gid", "left").na.fill(0)


def features(net: Network, clusters: DataFrame, config: RoleConfig = RoleConfig(), central: DataFrame | None = None) -> DataFrame:
    """One row for each node with all that roles and priority look at: sums of pairs in one aggregation, both FIFO folds and
    active days in one pass over the days, and reach, neighbouring clusters and betweenness, joined on gid."""
    b = central if central is not None else betweenness(net, None if config.centrality_mode == "exact" else config.betweenness_samples, seed=config.random_seed)
    rows = net.nodes
    for part in (turnover(net), seed_reach(net, config.max_depth), other_clusters(net, clusters), b, clusters):
        rows = rows.join(part, "gid")
    filled = ["active_days", "temporal_in", "temporal_out", "matched", "same_day", "strict_in", "strict_out", "strict_matched"]
    rows = rows.join(timing(net, config.transit_window_days), "gid", "left").na.fill(0, filled)
    rows = rows.withColumn("truncated", (F.col("depth") == config.max_depth) & (F.col("out_deg") == 0))
    return cut(rows, "features")  # read several times by the rules


def central_levels(rows: DataFrame, *configs: RoleConfig) -> dict[float, float]:
    """Betweenness at the quantiles of some configurations, of nodes with partners; 0 where there is none."""
    points = tuple(sorted({c.coordinator_centrality_quantile for c in configs}))
    found = exact_quantiles(rows.where("in_deg + out_deg > 0"), "betweenness", points).collect()  # a number for each point
    return dict.fromkeys(points, 0.0) | {r["p"]: r["value"] for r in found}


def classify(rows: DataFrame, config: RoleConfig = RoleConfig(), levels: dict[float, float] | None = None) -> DataFrame:
    """rows (of features) with matched_roles, role, role_score and peripheral_reason; levels: of central_levels, if known."""
    c = config
    level = (levels or central_levels(rows, config))[c.coordinator_centrality_quantile]
    rows = rows.withColumn("threshold", F.lit(level)).withColumn("reliable", ~F.col("is_seed") & ~F.col("truncated") & (F.col("ext_in_cents") > 0))
    v = F.col
    holds = {
        "coordinator": (v("in_deg") + v("out_deg") >= c.coordinator_min_degree) & (v("betweenness") > 0) & (v("betweenness") >= v("threshold")) & (v("other_clusters") >= c.coordinator_min_other_clusters) & (v("seed_reach") >= c.coordinator_min_seeds),
        "distributor": (v("out_deg") >= c.distributor_min_payees) & (v("out_deg") >= c.distributor_fan_ratio * F.greatest("in_deg", F.lit(1))),
        "consolidator": (v("in_deg") >= c.consolidator_min_payers) & (v("seed_reach") >= c.consolidator_min_seeds),
        "transit": v("reliable") & (v("in_deg") > 0) & (v("out_deg") > 0) & v("pass_through").between(c.transit_ratio_min, c.transit_ratio_max) & (F.least("temporal_in", "temporal_out") >= c.transit_min_matched_fraction),
        "terminal": v("reliable") & (v("out_deg") == 0),
    }
    extra = {
        "coordinator": (v("seed_reach") >= 5, v("other_clusters") >= 3, v("active_days") >= 3),
        "distributor": (v("out_deg") >= 10, v("active_days") >= 3, v("out_tx") >= 2 * F.greatest("out_deg", F.lit(1))),
        "consolidator": (v("in_deg") >= 10, v("seed_reach") >= 3, v("reliable") & (v("pass_through") <= 0.3)),
        "transit": (v("reliable") & v("pass_through").between(0.9, 1.1), F.least("strict_in", "strict_out") >= c.transit_min_matched_fraction, v("active_days") >= 3),
        "terminal": (v("in_deg") >= 2, v("in_tx") >= 3, v("active_days") >= 3),
    }
    yes = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.withColumn("matched_roles", F.array_compact(F.array(*[F.when(yes(holds[r]), F.lit(r)) for r in ROLES])))
    rows = rows.withColumn("role", F.when(F.size("matched_roles") > 0, F.get("matched_roles", F.lit(0))).otherwise("peripheral"))
    points = F.lit(2)
    for r in ROLES:
        points = F.when(v("role") == r, 6 + sum(yes(x).cast("int") for x in extra[r])).otherwise(points)
    rows = rows.withColumn("role_score", F.when(v("truncated"), F.least(points, F.lit(6))).otherwise(points) / 10)
    reason = F.when(v("in_deg") + v("out_deg") == 0, "isolated").when(v("truncated"), "truncated").when(v("is_seed"), "incomplete_seed").when(v("ext_in_cents") == 0, "no_observed_input").otherwise("no_rule")
    return rows.withColumn("peripheral_reason", F.when(v("role") == "peripheral", reason).otherwise("")).drop("threshold")


def prioritise(rows: DataFrame, config: RoleConfig = RoleConfig()) -> DataFrame:
    """rows (of classify) with the five priority parts and priority_score; a node without partners has 0."""
    w = config.priority_weights
    rows = cut(rows, "roles").withColumn("_flow", F.greatest("in_cents", "out_cents")).withColumn("_fan", F.greatest("in_deg", "out_deg"))
    active = rows.where("in_deg + out_deg > 0").select("gid", "_flow", "betweenness", "_fan")
    shares = rank_shares(active, {"_s_flow": "_flow", "_s_bridge": "betweenness", "_s_fan": "_fan"}).select("gid", "_s_flow", "_s_bridge", "_s_fan")
    both = rows.join(shares, "gid", "left")
    for name in ("flow", "bridge", "fan"):
        both = both.withColumn(f"p_{name}", F.coalesce(F.col(f"_s_{name}") * w[name], F.lit(0.0))).drop(f"_s_{name}")
    both = both.withColumn("p_seed_reach", F.least(F.col("seed_reach") / 5, F.lit(1.0)) * w["seed_reach"])
    both = both.withColumn("p_role_support", F.when(F.col("role") == "peripheral", 0.0).otherwise(F.col("role_score")) * w["role_support"])
    total = F.col("p_seed_reach") + F.col("p_flow") + F.col("p_bridge") + F.col("p_fan") + F.col("p_role_support")
    return both.withColumn("priority_score", F.when(F.col("in_deg") + F.col("out_deg") > 0, six(total)).otherwise(0.0)).drop("_flow", "_fan")


def evidence(rows: DataFrame) -> DataFrame:
    """rows with a sentence of at most 200 characters that names what the role rests on."""
    v = F.col
    said = (
        F.when(v("role") == "coordinator", F.format_string("lies between others (%.6f); %s other clusters; reached by %s seeds", v("betweenness"), v("other_clusters"), v("seed_reach")))
        .when(v("role") == "distributor", F.format_string("pays %s others in %s transfers, paid by %s", v("out_deg"), v("out_tx"), v("in_deg")))
        .when(v("role") == "consolidator", F.format_string("paid by %s others in %s transfers; reached by %s seeds", v("in_deg"), v("in_tx"), v("seed_reach")))
        .when(v("role") == "transit", F.format_string("passes on %.6f of its inflow", v("pass_through")))
        .when(v("role") == "terminal", F.format_string("received %.2f from %s others, sent nothing", v("in_cents") / 100, v("in_deg")))
        .otherwise(F.format_string("%s incoming and %s outgoing partners; %s", v("in_deg"), v("out_deg"), v("peripheral_reason")))
    )
    limit = F.when(v("truncated"), "payments beyond the last depth are unknown").when(v("is_seed"), "a seed's inflow is incomplete").otherwise("the full balance is unknown")
    return rows.withColumn("evidence", F.substring(F.concat(F.lit("Hypothesis: "), said, F.lit(". "), limit, F.lit(".")), 1, 200))


def top_nodes(rows: DataFrame, least: int = 20, most: int = 50) -> DataFrame:
    """(rank, gid, role, priority_score, reasons, why): the first nodes by priority, their two largest parts, and both in words."""
    n = rows.count()
    parts = F.array(*[F.struct((-F.col(f"p_{p}")).alias("x"), F.lit(p).alias("part")) for p in sorted(PARTS)])
    top = rows.orderBy(F.desc("priority_score"), "gid").limit(max(least, min(most, n)))
    ranked = evidence(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("priority_score"), "gid")))  # at most `most` rows
    ranked = ranked.withColumn("reasons", F.concat_ws(",", F.transform(F.slice(F.array_sort(parts), 1, 2), lambda p: p["part"])))
    return ranked.select("rank", "gid", "role", "priority_score", "reasons", F.concat_ws(" First by: ", "evidence", "reasons").alias("why"))


def cluster_summary(net: Network, rows: DataFrame, leaders: int = 5) -> DataFrame:
    """(cluster_id, n_nodes, n_seed, internal_cents, top_gids, dominant_role, dominant_n) of each cluster."""
    sizes = rows.groupBy("cluster_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seed"))
    at = lambda end: rows.select(F.col("gid").alias(end), F.col("cluster_id").alias(f"c_{end}"))
    inside = net.edges.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").groupBy(F.col("c_src").alias("cluster_id")).agg(F.sum("cents").alias("internal_cents"))
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("priority_score"), "gid"))
    tops = rows.select("cluster_id", "gid", "priority_score").withColumn("r", place).where(F.col("r") <= leaders).groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "gid"))), lambda x: x["gid"]).alias("top_gids"))
    roles = rows.groupBy("cluster_id", "role").agg(F.count("*").alias("n"), F.min("gid").alias("first"))
    dominant = roles.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "role")).alias("d"))
    dominant = dominant.select("cluster_id", F.col("d.role").alias("dominant_role"), (-F.col("d.n")).alias("dominant_n"))
    return sizes.join(inside, "cluster_id", "left").na.fill(0, ["internal_cents"]).join(tops, "cluster_id").join(dominant, "cluster_id")


def threshold_scenarios(config: RoleConfig = RoleConfig()) -> dict[str, RoleConfig]:
    """The rules as they are, relaxed by 0.8 and made strict by 1.2: minima rounded down or up and at least 1, the fan ratio
    scaled, the transit band widened or narrowed, the centrality quantile at 0.85 or 0.95."""
    made = {"base": config}
    minima = ("consolidator_min_payers", "consolidator_min_seeds", "distributor_min_payees", "coordinator_min_degree", "coordinator_min_seeds", "coordinator_min_other_clusters")
    for name, f in (("relaxed", 0.8), ("strict", 1.2)):
        whole = math.floor if f < 1 else math.ceil
        tolerance = 0.2 * (1.2 if f < 1 else 0.8)
        changed = {k: max(1, whole(getattr(config, k) * f)) for k in minima}
        changed |= {"distributor_fan_ratio": config.distributor_fan_ratio * f, "transit_ratio_min": 1 - tolerance, "transit_ratio_max": 1 + tolerance, "coordinator_centrality_quantile": 0.85 if f < 1 else 0.95}
        made[name] = replace(config, **changed)
    return made


def scenarios(rows: DataFrame, cases: dict[str, RoleConfig] | None = None) -> DataFrame:
    """(scenario, gid, cluster_id, role, priority_score): the rules again under each configuration, from the same features."""
    made = None
    rows, cases = cut(rows, "features"), cases or threshold_scenarios()
    levels = central_levels(rows, *cases.values())
    for name, config in cases.items():
        one = prioritise(classify(rows, config, levels), config).select(F.lit(name).alias("scenario"), "gid", "cluster_id", "role", "priority_score")
        made = one if made is None else made.unionByName(one)
    return made


def sensitivity(net: Network, config: RoleConfig = RoleConfig(), seeds: tuple[int, ...] = (0, 1, 7, 99), resolutions: tuple[float, ...] = (0.8, 1.2)) -> DataFrame:
    """(scenario, gid, cluster_id, role, priority_score): the whole run under other thresholds, pivots of sampled betweenness,
    resolutions of communities, and priority weights scaled one by one; features are made once for each graph metric."""
    base, central = cut(communities(net, config.louvain_resolution), "base"), cut(betweenness(net), "central")
    rows = features(net, base, config, central)
    weights = {f"weight {name}": replace(config, priority_weights=w) for name, w in weight_cases(config).items() if name != "base"}
    made = scenarios(rows, threshold_scenarios(config) | weights)
    for s in seeds:
        sampled = cut(betweenness(net, config.betweenness_samples, seed=s), "sampled")
        made = made.unionByName(scenarios(rows.drop("betweenness").join(sampled, "gid"), {f"betweenness_seed_{s}": config}))
    for r in resolutions:
        other = cut(communities(net, r), "other")
        made = made.unionByName(scenarios(rows.drop("cluster_id", "other_clusters").join(other, "gid").join(other_clusters(net, other), "gid"), {f"resolution_{r:g}": config}))
    return made


def pivot_scenarios(net: Network, clusters: DataFrame, samples: int, seeds: tuple[int, ...] = (0, 1, 7, 99), config: RoleConfig = RoleConfig()) -> DataFrame:
    """(scenario, gid, cluster_id, role, priority_score): the rules with betweenness from other pivots, over one clustering."""
    made, rows = None, None
    for s in seeds:
        sampled = cut(betweenness(net, samples, seed=s), "sampled")
        rows = features(net, clusters, config, sampled) if rows is None else rows.drop("betweenness").join(sampled, "gid")
        one = scenarios(rows, {f"betweenness_seed_{s}": config})
        made = one if made is None else made.unionByName(one)
    return made


def simple_rankings(rows: DataFrame, tops: tuple[int, ...] = (20, 50)) -> DataFrame:
    """(ranking, k, shared): of the first k nodes by one plain figure, how many are among the first k by priority; ties to the smaller gid."""
    plain = {
        "observed_flow_max": F.greatest("in_cents", "out_cents"), "observed_flow_in_plus_out": F.col("in_cents") + F.col("out_cents"), "fanin": F.col("in_deg"), "fanout": F.col("out_deg"),
        "seed_reach": F.col("seed_reach"), "exact_betweenness": F.col("betweenness"), "priority": F.col("priority_score"),
    }
    listed = rows.select("gid", F.explode(F.array(*[F.struct(F.lit(name).alias("ranking"), v.cast("double").alias("v")) for name, v in plain.items()])).alias("x")).select("gid", "x.*")
    order = Window.partitionBy("ranking").orderBy(F.desc("v"), "gid")  # a row number up to max(tops): each task keeps so many
    first = cut(listed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(tops)).select("ranking", "gid", "r"), "first")
    base = F.broadcast(first.where("ranking = 'priority'").select("gid", F.col("r").alias("r0")))  # max(tops) rows
    met = first.where("ranking <> 'priority'").join(base, "gid", "left").select("ranking", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), ((F.col("r") <= k) & (F.col("r0") <= k)).alias("both")) for k in tops])).alias("t"))
    return met.groupBy("ranking", "t.k").agg(F.coalesce(F.sum(F.col("t.both").cast("long")), F.lit(0).cast("long")).alias("shared"))


def compared(made: DataFrame, base: str = "base", tops: tuple[int, ...] = (20, 50)) -> DataFrame:
    """(scenario, role_changes, clusters, top20, top20_changes, ...): each scenario against the base: nodes whose role differs,
    clusters, and of the first nodes of the base by priority those that are first here too, and those whose role differs."""
    made = cut(made, "scenarios")
    place = F.row_number().over(Window.partitionBy("scenario").orderBy(F.desc("priority_score"), "gid"))
    first = made.select("scenario", "gid", "priority_score").withColumn("r", place).where(F.col("r") <= max(tops)).select("scenario", "gid", "r")
    rows = made.join(first, ["scenario", "gid"], "left")
    was = rows.where(F.col("scenario") == base).select("gid", F.col("role").alias("was"), F.col("r").alias("r0"))
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    other = F.col("role") != F.col("was")
    parts = [x for k in tops for x in (n((F.col("r") <= k) & (F.col("r0") <= k)).alias(f"top{k}"), n(other & (F.col("r0") <= k)).alias(f"top{k}_changes"))]
    return rows.join(was, "gid").groupBy("scenario").agg(n(other).alias("role_changes"), F.count_distinct("cluster_id").alias("clusters"), *parts)


def role_changes(made: DataFrame, a: str, b: str) -> DataFrame:
    """(before, after, n): roles of the same node in two scenarios."""
    of = lambda name, c: made.where(F.col("scenario") == name).select("gid", F.col("role").alias(c))
    return transitions(of(a, "x").join(of(b, "y"), "gid"), "x", "y")


def stability(made: DataFrame) -> DataFrame:
    """(gid, roles, stable) over scenarios."""
    return made.groupBy("gid").agg(F.count_distinct("role").alias("roles")).withColumn("stable", F.col("roles") == 1)


def hypotheses(summary: DataFrame) -> DataFrame:
    """(cluster_id, hypothesis): a sentence for each cluster of cluster_summary, to be checked by an analyst."""
    text = F.format_string("Hypothesis: a group of %s nodes, %s of them %s, with %s seeds.", "n_nodes", "dominant_n", "dominant_role", "n_seed")
    return summary.select("cluster_id", text.alias("hypothesis"))


def weight_cases(config: RoleConfig = RoleConfig(), factors: tuple[float, ...] = (0.8, 1.2)) -> dict[str, dict[str, float]]:
    """The weights by scenario: the base, and each weight scaled alone and all brought back to sum 1."""
    base = config.priority_weights
    cases = {"base": base}
    for part in PARTS:
        for f in factors:
            scaled = base | {part: base[part] * f}
            cases[f"{part} x {f:g}"] = {k: v / sum(scaled.values()) for k, v in scaled.items()}
    return cases


def weight_scenarios(rows: DataFrame, config: RoleConfig = RoleConfig(), factors: tuple[float, ...] = (0.8, 1.2)) -> DataFrame:
    """(scenario, gid, priority_score) under the weights of weight_cases, in one pass over scored rows."""
    base, cases = config.priority_weights, weight_cases(config, factors)
    score = lambda w: six(sum(F.col(f"p_{p}") * (w[p] / base[p] if base[p] else 0.0) for p in PARTS))
    made = F.array(*[F.struct(F.lit(name).alias("scenario"), F.when(F.col("in_deg") + F.col("out_deg") > 0, score(w)).otherwise(0.0).alias("priority_score")) for name, w in cases.items()])
    return rows.select("gid", F.explode(made).alias("s")).select("s.scenario", "gid", "s.priority_score")


def selection_profile(chosen: DataFrame) -> DataFrame:
    """One row about a selection of scored rows: nodes, seeds, roles, clusters, mean reach, flow."""
    return chosen.agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seeds"), F.count_distinct("role").alias("n_roles"), F.count_distinct("cluster_id").alias("n_clusters"), six(F.avg("seed_reach")).alias("mean_reach"), F.sum("in_cents").alias("in_cents"))
