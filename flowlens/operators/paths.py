"""Reachability, components, cycles and time-respecting paths, as rounds of joins."""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.components import component_roots
from flowlens.plans.shared import cut, cut_and_sum, forget, sums_before
from flowlens.sources.tables import Network


def numbered(net: Network, roots: DataFrame) -> DataFrame:
    """(gid, component_id): ids 0, 1, ... in the order of each component's smallest gid."""
    rows = net.nodes.select("gid").join(roots, F.col("gid") == F.col("node"), "left").select("gid", F.coalesce("root", "gid").alias("root"))
    ids = sums_before(rows.select("root").distinct(), ["root"], component_id=F.lit(1).cast("long"))
    return rows.join(ids, "root").select("gid", "component_id")


def components(net: Network) -> DataFrame:
    """Weak components of the whole graph, isolates and edges without money included."""
    return numbered(net, component_roots(net.edges))


def projection_components(net: Network) -> DataFrame:
    """Weak components over pairs of different nodes that moved money."""
    return numbered(net, component_roots(net.links.where("cents > 0")))


def spanning_tree(links: DataFrame) -> tuple[int, DataFrame]:
    """(levels, tree) of undirected links (a, b), both ways round: breadth-first trees from the smallest node of each component. levels:
    how many; tree: (node, root, parent, depth, size, place), the roots' parents null, with the nodes of the subtree, and each root's tree in
    preorder from place 0. Rounds are as many as levels, and a round reads the rows of two levels."""
    roots = component_roots(links, "a", "b").select("node", "root")
    first = links.select(F.col("a").alias("node")).distinct().join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    level = cut(first.where("node = root").select("node", F.lit(None).cast("long").alias("parent")), "level")
    levels = [level]
    while True:
        seen = reduce(DataFrame.unionByName, levels[-2:]).select("node")  # links lead one level on at most
        ahead = level.select(F.col("node").alias("a")).join(links, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        level = cut(ahead.join(seen, "node", "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
    sized, below = [], None
    for level in reversed(levels):
        rows = level.withColumn("size", F.lit(1).cast("long"))
        if below is not None:
            own = below.groupBy(F.col("parent").alias("node")).agg(F.sum("size").alias("under"))
            rows = level.join(own, "node", "left").select("node", "parent", (F.coalesce("under", F.lit(0)) + 1).alias("size"))
        below = cut(rows, "sizes")
        sized.append(below)
    above, placed = None, []
    for depth, rows in enumerate(reversed(sized)):
        if above is None:
            made = rows.withColumn("place", F.lit(0).cast("long"))
        else:
            # the children of a node one after another: a window over the children of one node
            before = F.coalesce(F.sum("size").over(Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            made = rows.withColumn("before", before).join(above.select(F.col("node").alias("parent"), F.col("place").alias("p")), "parent").select("node", "parent", "size", (F.col("p") + 1 + F.col("before")).alias("place"))
        above = cut(made.withColumn("depth", F.lit(depth)), "places")
        placed.append(above)
    tree = cut(reduce(DataFrame.unionByName, placed).join(first, "node").select("node", "root", "parent", "depth", "size", "place"), "tree")
    forget(level, *levels, *sized, *placed)
    return len(levels), tree


def pieces(links: DataFrame) -> DataFrame:
    """(node, root, parts, largest): for every node of undirected links (a, b) its component, and into how many parts the rest of
    that falls without the node, and the largest one's nodes.

    Tarjan and Vishkin's blocks (1985), in rows in proportion to the links: in a tree in preorder the links of a node to its
    parent stand for blocks; two of them share one if a link joins their subtrees apart, or if a link leads from the lower one's subtree out of
    the upper one's. Components of these pairs are the blocks; a node's parts are the blocks that hang below it, and what is above.
    """
    both = cut(links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p")).select("p.*").distinct(), "both")
    levels, tree = spanning_tree(both)
    end = lambda e: tree.select(F.col("node").alias(e), *[F.col(c).alias(f"{c}_{e}") for c in ("parent", "size", "place")])
    named = both.join(end("a"), "a").join(end("b"), "b")
    other = cut(named.where("not (parent_a <=> b) and not (parent_b <=> a)"), "others")  # links that are not the tree's
    own = other.groupBy(F.col("a").alias("node")).agg(F.min("place_b").alias("low"), F.max("place_b").alias("high"))
    rows = cut(tree.join(own, "node", "left").select("node", "parent", "depth", "size", "place", F.coalesce("low", "place").alias("low"), F.coalesce("high", "place").alias("high")), "reach")
    below, spans = None, []
    for depth in range(levels - 1, -1, -1):  # what a subtree's links reach
        level = rows.where(F.col("depth") == depth)
        if below is not None:
            under = below.groupBy(F.col("parent").alias("node")).agg(F.min("low").alias("low_"), F.max("high").alias("high_"))
            level = level.join(under, "node", "left").select("node", "parent", "depth", "size", "place", F.least("low", "low_").alias("low"), F.greatest("high", "high_").alias("high"))
        below = cut(level, "spans")
        spans.append(below)
    each, spans = spans, cut(reduce(DataFrame.unionByName, spans), "span")
    forget(rows, *each)
    apart = other.where("place_a + size_a <= place_b").select("a", "b")
    upper = spans.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("place").alias("p"), F.col("size").alias("n"))
    joined = spans.select("node", "parent", "low", "high").join(upper, "parent").where("above is not null and (low < p or high >= p + n)").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    blocks = component_roots(cut(apart.unionByName(joined), "pairs"), "a", "b").select("node", F.col("root").alias("block"))
    named = cut(tree.join(blocks, "node", "left").select("node", "root", "parent", "size", F.coalesce("block", "node").alias("block")), "blocks")
    hung = named.where("parent is not null").groupBy(F.col("parent").alias("at"), F.col("block").alias("under")).agg(F.sum("size").alias("n"))
    hung = named.join(hung, F.col("node") == F.col("at")).where("parent is null or under <> block").groupBy("node").agg(F.count("*").alias("k"), F.max("n").alias("most"), F.sum("n").alias("all"))
    whole = named.where("parent is null").select("root", F.col("size").alias("total"))
    rest = F.when(F.col("parent").isNull(), F.lit(0)).otherwise(F.col("total") - 1 - F.coalesce("all", F.lit(0)))  # with the parent
    met = named.join(hung, "node", "left").join(whole, "root").withColumn("rest", rest)
    return met.select("node", "root", (F.coalesce("k", F.lit(0)) + (F.col("rest") > 0).cast("long")).alias("parts"), F.greatest(F.coalesce("most", F.lit(0)), "rest").alias("largest"))


def resilience(net: Network, removed: DataFrame) -> DataFrame:
    """(removed, n_components, largest, cut_off): for each node of `removed` (gid) the weak components of the rest of the graph without
    it, the size of the largest, and nodes that lose their last partner.

    One search for all nodes, whatever their number: see pieces.
    """
    links = net.links.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = cut(pieces(links), "pieces")
    linked = cut(found.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    lone = net.nodes.count() - found.count()
    two = [r["n"] for r in linked.orderBy(F.desc("n")).limit(2).collect()]  # the two largest components
    many, (first, second) = linked.count() + lone, (two + [min(1, lone)] * 2)[:2]
    cases = removed.select(F.col("gid").alias("removed")).distinct().join(found.withColumnRenamed("node", "removed"), "removed", "left").join(linked, "root", "left")
    cases = cases.join(net.nodes.select(F.col("gid").alias("removed"), F.lit(1).cast("long").alias("own")), "removed", "left").na.fill(0, ["own"])
    others = F.when(F.col("n") == first, F.lit(second)).otherwise(F.lit(first))
    without = F.when(F.col("n").isNull(), F.lit(first) if two else F.least(F.lit(1), F.lit(lone) - F.col("own"))).otherwise(F.greatest(others, "largest"))
    rows = cases.select("removed", (F.lit(many) - F.col("own") + F.coalesce("parts", F.lit(0))).alias("n_components"), without.cast("long").alias("largest")).where("n_components > 0")
    own = net.links.select(F.explode(F.array(F.struct(F.col("src").alias("gid"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("gid"), F.col("src").alias("other")))).alias("p")).select("p.*").groupBy("gid").agg(F.count_distinct("other").alias("partners"), F.min("other").alias("only"))
    last = own.where("partners = 1").groupBy(F.col("only").alias("removed")).agg(F.count("*").alias("cut_off"))
    return rows.join(last, "removed", "left").na.fill(0, ["cut_off"])


def common_recipients(net: Network, payers: DataFrame, least: int = 2) -> DataFrame:
    """(gid, n_payers, cents, first_day, last_day): whom at least `least` of the payers (gid) pay, with what and when; payers are matched
    by a join, and a recipient's rows are summed by payer before they meet."""
    wanted = payers.select(F.col("gid").alias("src")).distinct()
    sent = net.tx.where("src <> dst").groupBy("src", "dst").agg(F.sum("cents").alias("cents"), F.min("day").alias("first"), F.max("day").alias("last")).join(wanted, "src", "left_semi")
    met = sent.groupBy(F.col("dst").alias("gid")).agg(F.count("*").alias("n_payers"), F.sum("cents").alias("cents"), F.min("first").alias("first_day"), F.max("last").alias("last_day"))
    return met.where(F.col("n_payers") >= least)


def component_profile(net: Network, of: DataFrame) -> DataFrame:
    """Per component: nodes, seeds, pairs, transactions, turnover, and the node with most payees (ties: smallest gid)."""
    nodes = net.nodes.join(of, "gid")
    out = net.links.groupBy(F.col("src").alias("gid")).count()
    lead = nodes.join(out, "gid", "left").na.fill(0, ["count"]).groupBy("component_id").agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seeds"), F.min(F.struct((-F.col("count")).alias("x"), "gid"))["gid"].alias("leader"), F.max("count").alias("leader_payees"))
    edges = net.edges.join(of, F.col("src") == F.col("gid")).groupBy("component_id").agg(F.count("*").alias("n_edges"), F.sum("n_tx").alias("n_tx"), F.sum("cents").alias("cents"))
    return lead.join(edges, "component_id", "left").na.fill(0)


def walk(links: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """(seed, node) pairs joined by a directed path of at most `most` links; starts: (seed, node). Two rounds are planned together."""
    pairs, seen = links.select("src", "dst"), starts.withColumn("k", F.lit(0))
    for k in range(1, most + 1, 2):
        step, known = seen.where(F.col("k") == k - 1), seen
        for j in range(k, min(k + 2, most + 1)):
            found = step.join(pairs, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
            step = found.join(known, ["seed", "node"], "left_anti").withColumn("k", F.lit(j))
            new = step if j == k else new.unionByName(step)
            known = known.unionByName(step)
        seen = seen.unionByName(cut(new, "walk"))
    return seen.drop("k")


def seeds(net: Network) -> DataFrame:
    return net.nodes.where("is_seed").select(F.col("gid").alias("seed"), F.col("gid").alias("node"))


def seed_bits(net: Network, most: int) -> DataFrame:
    """(gid, block, bits): for each node the seeds with a path to it of at most `most` links, itself included if it is one, as
    bits of 64 seeds a row; rows without a bit are left out. A seed is number 64 * block + bit in the order of gids.

    A round is one join and one aggregation: what a node newly holds goes along its links, and sets meet by `bit_or`, which
    combines before the shuffle, so a hub receives one row a task and block; there are never more rows than nodes times blocks.
    """
    order = sums_before(net.nodes.where("is_seed").select("gid").distinct(), ["gid"], n=F.lit(1).cast("long"))
    zero = F.lit(0).cast("long")
    state = order.select("gid", F.floor(F.col("n") / 64).alias("block"), zero.alias("held"), F.expr("shiftleft(1L, cast(n % 64 as int))").alias("fresh"))
    state, pairs = cut(state, "bits"), net.links.select("src", "dst")
    for k in range(most):
        sent = state.where("fresh <> 0").join(pairs, F.col("gid") == F.col("src")).select(F.col("dst").alias("gid"), "block", zero.alias("held"), F.col("fresh").alias("got"))
        own = state.select("gid", "block", F.col("held").bitwiseOR(F.col("fresh")).alias("held"), zero.alias("got"))
        met = own.unionByName(sent).groupBy("gid", "block").agg(F.bit_or("held").alias("held"), F.bit_or("got").alias("got"))
        state = met.select("gid", "block", "held", F.col("got").bitwiseAND(F.bitwise_not("held")).alias("fresh"))
        if k % 2:  # two rounds are planned together
            state = cut(state, "bits")
    return state.select("gid", "block", F.col("held").bitwiseOR(F.col("fresh")).alias("bits"))


def seed_reach(net: Network, max_depth: int = 4) -> DataFrame:
    """(gid, seed_reach): seeds other than the node itself with a path to it of at most max_depth links."""
    found = seed_bits(net, max_depth).groupBy("gid").agg(F.sum(F.bit_count("bits")).alias("n"))
    own = F.col("is_seed").cast("long")
    return net.nodes.join(found, "gid", "left").select("gid", (F.coalesce("n", own) - own).alias("seed_reach"))


def reciprocal(net: Network) -> DataFrame:
    """(a, b, ab_cents, ba_cents), a < b: pairs that pay each other."""
    x = net.links.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.col("cents").alias("ab_cents"))
    y = net.links.where("src > dst").select(F.col("dst").alias("a"), F.col("src").alias("b"), F.col("cents").alias("ba_cents"))
    return x.join(y, ["a", "b"])


def edge_days(net: Network) -> DataFrame:
    """(src, dst, days): each pair's distinct days, in order, self-transfers left out."""
    return net.tx.where("src <> dst").groupBy("src", "dst").agg(F.sort_array(F.collect_set(F.unix_date("day"))).alias("days"))


def wedges(net: Network) -> DataFrame:
    """One row: two-step paths between different nodes, those whose days allow it, strictly, and those with a shortcut.

    Nothing is made for each pair at a node: paths are counted from the days on which a node's links begin and end, and
    shortcuts from triangles, which are grown at their node of fewest partners.
    """
    d = edge_days(net).select("src", "dst", F.array_min("days").alias("first"), F.array_max("days").alias("last"))
    d = cut(d, "wedges")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    at = d.select(F.col("dst").alias("m"), F.col("first").alias("day"), F.lit(1).alias("inn"), F.lit(0).alias("out")).unionByName(d.select(F.col("src").alias("m"), F.col("last").alias("day"), F.lit(0).alias("inn"), F.lit(1).alias("out")))
    at = at.groupBy("m", "day").agg(F.sum("inn").alias("inn"), F.sum("out").alias("out"))  # a row for each day of a node
    upto = Window.partitionBy("m").orderBy("day")
    run = at.select("m", "inn", "out", F.sum("inn").over(upto).alias("sofar"))
    counted = run.groupBy("m").agg(F.sum("inn").alias("ins"), F.sum("out").alias("outs"), F.sum(F.col("out") * F.col("sofar")).alias("ok"), F.sum(F.col("out") * (F.col("sofar") - F.col("inn"))).alias("strict"))
    open_ = counted.agg(n(F.col("ins") * F.col("outs")).alias("w"), n(F.col("ok")).alias("ok"), n(F.col("strict")).alias("strict"))
    back = d.alias("x").join(d.alias("y"), (F.col("x.src") == F.col("y.dst")) & (F.col("x.dst") == F.col("y.src")))  # paths that return
    back = back.agg(F.count("*").alias("bw"), n((F.col("x.first") <= F.col("y.last")).cast("long")).alias("bok"), n((F.col("x.first") < F.col("y.last")).cast("long")).alias("bstrict"))
    both = open_.crossJoin(back).crossJoin(shortcuts(net))  # one row each
    return both.select((F.col("w") - F.col("bw")).alias("wedges"), (F.col("ok") - F.col("bok")).alias("in_time"), (F.col("strict") - F.col("bstrict")).alias("strictly"), "closed")


def shortcuts(net: Network) -> DataFrame:
    """One row (closed): paths a, m, b of two links whose ends have a link from a to b.

    Partners are ordered by their number; every triangle is grown once, at its first node, so a hub grows none of its pairs.
    """
    links = net.links.select("src", "dst")
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up")).groupBy("a", "b").agg(F.max(F.col("up").cast("int")).alias("ab"), F.max((~F.col("up")).cast("int")).alias("ba"))
    pairs = cut(pairs, "pairs")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("g")).groupBy("g").agg(F.count("*").alias("n"))
    at = lambda end: degree.select(F.col("g").alias(end), F.struct("n", "g").alias(f"k{end}"))
    named = pairs.join(at("a"), "a").join(at("b"), "b")
    up = F.col("ka") < F.col("kb")
    way = lambda x, y: F.when(up, F.col(x)).otherwise(F.col(y))
    rows = cut(named.select(F.when(up, F.col("ka")).otherwise(F.col("kb")).alias("lo"), F.when(up, F.col("kb")).otherwise(F.col("ka")).alias("hi"), way("ab", "ba").alias("f"), way("ba", "ab").alias("g")), "ordered")
    side = lambda name: rows.select("lo", F.col("hi").alias(name), F.col("f").alias(f"f{name}"), F.col("g").alias(f"g{name}"))
    thirds = rows.select(F.col("lo").alias("v"), F.col("hi").alias("w"), F.col("f").alias("vw"), F.col("g").alias("wv"))
    found = side("v").join(side("w"), "lo").where(F.col("v") < F.col("w")).join(thirds, ["v", "w"])
    # of lo, v, w each order (a, m, b) counts if it has all three links
    has = {("u", "v"): "fv", ("v", "u"): "gv", ("u", "w"): "fw", ("w", "u"): "gw", ("v", "w"): "vw", ("w", "v"): "wv"}
    total = sum(F.col(has[a, m]) * F.col(has[m, b]) * F.col(has[a, b]) for a, m, b in permutations("uvw"))
    return found.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("closed"))


def cycles(net: Network, longest: int = 6) -> DataFrame:
    """(members, length): simple directed cycles, each once, its smallest gid first.

    Rooted at the smallest member: paths only grow through larger ids, so no rotation is made twice. Half a cycle is
    grown forward from the root and half backward, and the halves meet at the same root and node; so paths have at
    most half the length, and a busy node's paths are spread over the roots they meet.
    """
    links = net.links.select("src", "dst")
    ahead = cut(links.where("dst > src").select(F.col("src").alias("root"), F.col("dst").alias("cur"), F.array("dst").alias("fore")), "cycles")
    behind = cut(links.where("src > dst").select(F.col("dst").alias("root"), F.col("src").alias("cur"), F.array().cast("array<bigint>").alias("aft")), "cycles")
    found = None
    for n in range(2, longest + 1):
        if n > 2 and n % 2:
            grown = ahead.join(links, F.col("cur") == F.col("src")).where((F.col("dst") > F.col("root")) & ~F.array_contains("fore", F.col("dst")))
            ahead = cut(grown.select("root", F.col("dst").alias("cur"), F.concat("fore", F.array("dst")).alias("fore")), "cycles")
        elif n > 2:
            grown = behind.join(links, F.col("cur") == F.col("dst")).where((F.col("src") > F.col("root")) & ~F.array_contains("aft", F.col("src")) & (F.col("src") != F.col("cur")))
            behind = cut(grown.select("root", F.col("src").alias("cur"), F.concat(F.array("cur"), "aft").alias("aft")), "cycles")
        met = ahead.join(behind, ["root", "cur"]).where(~F.arrays_overlap("fore", "aft"))
        closed = met.select(F.concat(F.array("root"), "fore", "aft").alias("members"), F.lit(n).alias("length"))
        found = closed if found is None else found.unionByName(closed)
    return found


def cycle_stats(found: DataFrame) -> DataFrame:
    return found.groupBy("length").agg(F.count("*").alias("n"), F.count_distinct(F.element_at("members", 1)).alias("roots"))


def _passes(days: Column, hops: Column, gap: int, window: int | None) -> Column:
    """Whether some start day lets every hop follow the one before by at least `gap` days, all within window."""

    def from_day(start: Column) -> Column:
        nxt = lambda a, h: F.array_min(F.filter(h, lambda d: d >= a + gap))
        end = F.aggregate(F.slice(days, 2, hops), start, lambda a, h: nxt(a, h))
        return end.isNotNull() & ((end <= start + window) if window is not None else F.lit(True))

    return F.exists(F.element_at(days, 1), from_day)


def dated_cycles(net: Network, longest: int = 6, window: int = 2) -> DataFrame:
    """Per length: cycles whose days allow a round trip from some member: in order, strictly, in order within window days."""
    found = cycles(net, longest).withColumn("id", F.monotonically_increasing_id())
    found = cut(found, "dated")
    hop = found.select("id", "length", F.posexplode("members").alias("i", "src"), "members")
    hop = hop.withColumn("dst", F.element_at("members", F.when(F.col("i") + 1 < F.col("length"), F.col("i") + 2).otherwise(1)))
    dated = hop.join(edge_days(net), ["src", "dst"]).groupBy("id", "length").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "days"))), lambda h: h["days"]).alias("days"))
    turned = dated.select("id", "length", F.explode(F.sequence(F.lit(1), "length")).alias("r"), "days").select("id", "length", F.concat(F.slice("days", F.col("r"), F.col("length")), F.slice("days", F.lit(1), F.col("r") - 1)).alias("days"))
    n = lambda g, w: _passes(F.col("days"), F.col("length") - 1, g, w)
    each = turned.groupBy("id", "length").agg(F.bool_or(n(0, None)).alias("in_order"), F.bool_or(n(1, None)).alias("strictly"), F.bool_or(n(0, window)).alias("in_window"))
    return each.groupBy("length").agg(F.count("*").alias("n"), *[F.sum(F.col(c).cast("long")).alias(c) for c in ("in_order", "strictly", "in_window")])


def temporal_reach(net: Network, most: int = 4, strict: bool = False) -> DataFrame:
    """(seed, node, day): nodes that money could reach from a seed in at most `most` links on days that do not fall
    (strict: rise), and the earliest arrival. Each round keeps a pair's earliest arrival only, which dominates."""
    days = net.tx.where("src <> dst").select("src", "dst", F.unix_date("day").alias("d")).distinct()
    state, every = seeds(net).withColumn("day", F.lit(-1_000_000)), None
    for k in range(0, most, 2):  # two rounds are planned together
        for j in range(k, min(k + 2, most)):
            later = F.col("d") > F.col("day") if strict else F.col("d") >= F.col("day")
            state = state.join(days, (F.col("node") == F.col("src")) & later).groupBy("seed", F.col("dst").alias("node")).agg(F.min("d").alias("day"))
            tagged = state.withColumn("k", F.lit(j))
            new = tagged if j == k else new.unionByName(tagged)
        new = cut(new, "temporal")
        state = new.where(F.col("k") == j).drop("k")
        every = new if every is None else every.unionByName(new)
    return every.where("seed <> node").groupBy("seed", "node").agg(F.date_from_unix_date(F.min("day")).alias("day"))


def state_reach(net: Network, most: int = 4) -> DataFrame:
    """(seed, node): the same by every (node, day) state; a slower cross-check of temporal_reach."""
    days = net.tx.where("src <> dst").select("src", "dst", F.unix_date("day").alias("d")).distinct()
    state = seeds(net).withColumn("day", F.lit(-1_000_000))
    every = state
    for _ in range(most):
        state = cut(state.join(days, (F.col("node") == F.col("src")) & (F.col("d") >= F.col("day"))).select("seed", F.col("dst").alias("node"), F.col("d").alias("day")).distinct(), "states")
        every = every.unionByName(state)
    return every.where("seed <> node").select("seed", "node").distinct()


def incompatible_pairs(net: Network) -> DataFrame:
    """(seed, node): within reach on paper, but on no days that money could have moved."""
    reach = walk(net.links, seeds(net), 4).where("seed <> node")
    return reach.join(temporal_reach(net), ["seed", "node"], "left_anti").select("seed", "node")


def first_impossible(net: Network, most: int = 4) -> DataFrame:
    """(seed, node, path, edge): of pairs within reach that no days allow, a shortest path and the first of its links, from 1,
    that cannot follow the earliest arrival before it."""
    pairs = incompatible_pairs(net)
    routes = shortest_witness(net, most).join(pairs, ["seed", "node"], "left_semi")
    hop = routes.select("seed", "node", "path", F.posexplode(F.slice("path", F.lit(2), F.size("path") - 1)).alias("i", "dst")).withColumn("src", F.get("path", "i"))
    dated = hop.join(edge_days(net), ["src", "dst"]).groupBy("seed", "node").agg(F.first("path").alias("path"), F.transform(F.sort_array(F.collect_list(F.struct("i", "days"))), lambda h: h["days"]).alias("days"))
    start = F.struct(F.lit(-1_000_000).alias("day"), F.lit(0).alias("bad"), F.lit(0).alias("i"))

    def step(a: Column, days: Column) -> Column:
        later = F.array_min(F.filter(days, lambda d: d >= a["day"]))
        bad = F.when((a["bad"] == 0) & later.isNull(), a["i"] + 1).otherwise(a["bad"])
        return F.struct(F.coalesce(later, a["day"]).alias("day"), bad.alias("bad"), (a["i"] + 1).alias("i"))

    return dated.select("seed", "node", "path", F.aggregate("days", start, step, lambda a: a["bad"]).alias("edge"))


def shortest_witness(net: Network, most: int = 4) -> DataFrame:
    """(seed, node, path): of the shortest paths of at most `most` links, the smallest."""
    links = net.links.select("src", "dst")
    edge = seeds(net).withColumn("path", F.array("seed"))
    seen = edge
    for _ in range(most):
        grown = edge.join(links, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        edge = cut(grown.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").groupBy("seed", "node").agg(F.min("path").alias("path")), "witness")
        seen = seen.unionByName(edge)
    return seen.where("seed <> node")


def simple_paths(net: Network, most: int = 4) -> DataFrame:
    """(seed, node, hops, n): simple paths from seeds by length."""
    links = net.links.select("src", "dst")
    path = seeds(net).withColumn("path", F.array("seed"))
    every = None
    for n in range(1, most + 1):
        grown = path.join(links, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        path = cut(grown.select("seed", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path")), "simple")
        one = path.groupBy("seed", "node").count().select("seed", "node", F.lit(n).alias("hops"), F.col("count").alias("n"))
        every = one if every is None else every.unionByName(one)
    return every


def ego_network(net: Network, center: int, radius: int = 1) -> DataFrame:
    """(src, dst, cents): edges among the nodes within radius links of center, in either direction."""
    both = net.links.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(net.links.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    near = net.nodes.where(F.col("gid") == center).select("gid")
    for _ in range(radius):
        near = near.unionByName(near.join(both, F.col("gid") == F.col("a")).select(F.col("b").alias("gid"))).distinct()
    ends = net.edges.join(near, F.col("src") == F.col("gid"), "left_semi")
    return ends.join(near, F.col("dst") == F.col("gid"), "left_semi").select("src", "dst", "cents")


def chain_ends(steps: DataFrame) -> DataFrame:
    """(v, end, low, ring): where the unique steps (v, to) from v lead in the end, the least node passed on the way, v included, and
    whether they lead round a ring instead. Pointer doubling: rounds grow with the logarithm of the longest chain.
    """
    state, open_ = cut(steps.select("v", F.col("to").alias("end"), F.col("v").alias("low"), F.lit(True).alias("ring")), "chains"), None
    while True:
        ahead = state.select(F.col("v").alias("end"), F.col("end").alias("next"), F.col("low").alias("further"))
        jumped = state.join(ahead, "end", "left").select("v", F.coalesce("next", "end").alias("end"), F.least("low", F.coalesce("further", "low")).alias("low"), F.col("next").isNotNull().alias("ring"), (F.col("further") < F.col("low")).alias("fell"))
        last = state
        state, seen = cut_and_sum(jumped, "chains", open=F.sum(F.col("ring").cast("long")), fell=F.sum(F.col("fell").cast("long")))
        forget(last)
        state = state.drop("fell")
        if not seen["open"] or (seen["open"] == open_ and not seen["fell"]):
            return state
        open_ = seen["open"]


def _shortened(links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(links, chains, rings, number of nodes left out): nodes with one link in and one out give way to one link from the node before their
    chain to the node after it. chains: (v, head, tail); rings: (gid, c) of chains that close upon themselves.
    """
    ways = links.where("src <> dst").select(F.col("src").alias("v"), F.col("dst").alias("to"), F.lit(1).alias("out")).unionByName(links.where("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("to"), F.lit(0).alias("out")))
    n_out, n_in = F.sum("out"), F.sum(1 - F.col("out"))
    ways = ways.groupBy("v").agg(n_out.alias("n_out"), n_in.alias("n_in"), F.max(F.when(F.col("out") == 1, F.col("to"))).alias("to"), F.max(F.when(F.col("out") == 0, F.col("to"))).alias("from"))
    looped = links.where("src = dst").select(F.col("src").alias("v"))
    passing, seen = cut_and_sum(ways.where("n_out = 1 and n_in = 1").join(looped, "v", "left_anti").select("v", "to", "from"), "passing", n=F.count("*"))
    if not seen["n"]:
        return links, passing.select("v", F.col("from").alias("head"), F.col("to").alias("tail")), passing.select(F.col("v").alias("gid"), F.col("to").alias("c")), 0
    ahead, back = chain_ends(passing.select("v", "to")), chain_ends(passing.select("v", F.col("from").alias("to")))
    rings = ahead.where("ring").select(F.col("v").alias("gid"), F.col("low").alias("c"))
    chains = cut(ahead.where("not ring").select("v", F.col("end").alias("tail")).join(back.select("v", F.col("end").alias("head")), "v"), "chains")
    inner = passing.select("v")
    kept = links.join(inner, F.col("src") == F.col("v"), "left_anti").join(inner, F.col("dst") == F.col("v"), "left_anti")
    shorter = cut(kept.unionByName(chains.select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct(), "scc")
    return shorter, chains, rings, seen["n"]


def _trimmed(links: DataFrame) -> tuple[DataFrame, int]:
    """Links between nodes that have a link in and one out, and how many were left out."""
    starts, ends = links.select(F.col("src").alias("g")).distinct(), links.select(F.col("dst").alias("g")).distinct()
    marked = links.join(ends.select(F.col("g").alias("src"), F.lit(True).alias("fed")), "src", "left").join(starts.select(F.col("g").alias("dst"), F.lit(True).alias("feeds")), "dst", "left")
    marked, seen = cut_and_sum(marked.select("src", "dst", (F.col("fed").isNotNull() & F.col("feeds").isNotNull()).alias("stays")), "scc", gone=F.sum((~F.col("stays")).cast("long")))
    return marked.where("stays").drop("stays"), seen["gone"] or 0


def strong_components(net: Network) -> DataFrame:
    """(gid, scc_id) of nodes on a directed cycle; scc_id: the component's smallest gid.

    Chains of nodes with one link in and one out become one link, by pointer doubling, and links that lie on no cycle are trimmed, in
    turn, until neither helps; so a chain or a ring of any length takes rounds by its logarithm. Of what is left every node is
    a pivot: it takes the smallest gid that reaches it, and the nodes of that colour that reach back to it are its
    component. Each round settles at least the components of the smallest ids. Chains get their ends' component at the end.
    """
    links, chains, done = cut(net.links.select("src", "dst"), "scc"), [], []
    while True:
        while True:
            links, gone = _trimmed(links)
            links, chain, rings, short = _shortened(links)
            if short:
                chains.append(chain)
                done.append(rings)
            if not gone and not short:
                break
        if links.isEmpty():
            break
        color = cut(links.select(F.col("src").alias("gid")).distinct().withColumn("c", F.col("gid")), "color")
        while True:
            low = links.join(color, F.col("src") == F.col("gid")).groupBy(F.col("dst").alias("gid")).agg(F.min("c").alias("m"))
            last = color
            color, seen = cut_and_sum(color.join(low, "gid", "left").select("gid", F.least("c", F.coalesce("m", "c")).alias("c"), (F.col("m") < F.col("c")).alias("moved")), "color", moved=F.sum(F.col("moved").cast("long")))
            forget(last)
            color = color.drop("moved")
            if not seen["moved"]:
                break
        inner = links.join(color.select(F.col("gid").alias("src"), F.col("c").alias("cs")), "src").join(color.select(F.col("gid").alias("dst"), F.col("c").alias("cd")), "dst").where("cs = cd")
        inner = cut(inner.select("src", "dst", "cs"), "scc")
        back = frontier = color.where("gid = c").select("gid", "c")
        while True:
            found = frontier.join(inner, F.col("gid") == F.col("dst")).select(F.col("src").alias("gid"), F.col("cs").alias("c")).distinct()
            frontier, seen = cut_and_sum(found.join(back, "gid", "left_anti"), "back", n=F.count("*"))
            if not seen["n"]:
                break
            back = back.unionByName(frontier)
        back = cut(back, "back")
        done.append(back)
        links = cut(links.join(back, F.col("src") == F.col("gid"), "left_anti").join(back, F.col("dst") == F.col("gid"), "left_anti"), "scc")
    found = net.nodes.where("false").select("gid", F.col("gid").alias("c"))
    for part in done:
        found = found.unionByName(part)
    for chain in reversed(chains):  # a chain lies on a cycle if its ends share a component
        end = lambda e: found.select(F.col("gid").alias(e), F.col("c").alias(f"c{e}"))  # noqa: B023, E731
        found = cut(found.unionByName(chain.join(end("head"), "head").join(end("tail"), "tail").where("chead = ctail").select(F.col("v").alias("gid"), F.col("chead").alias("c"))), "found")
    sized = found.groupBy("c").agg(F.count("*").alias("n"), F.min("gid").alias("scc_id")).where("n > 1")
    return found.join(sized, "c").select("gid", "scc_id")
