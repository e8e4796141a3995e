"""Betweenness, PageRank and HITS as rounds of joins over frontiers."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.flows import nine, six
from flowlens.plans.shared import cut, cut_and_sum, forget, sums_before
from flowlens.sources.tables import Network


def pivots(net: Network, k: int, seed: int = 42) -> DataFrame:
    """(s): the k nodes whose MD5 of `seed:gid` is smallest; the same whatever the partitioning."""
    return _drawn(net, seed).orderBy("h", "s").limit(k).select("s")


def _drawn(net: Network, seed: int) -> DataFrame:
    return net.nodes.select(F.col("gid").alias("s"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("gid").cast("string"))).alias("h"))


#: Links up to which each group of sources is given a copy of the links (some 330 bytes each while a task works); beyond,
#: frontiers are joined. Cells (sources x nodes, and links) that a task works on at once.
SMALL_LINKS, CELLS = 4_000_000, 500_000

#: Sources that search a graph together, a bit of a word each, and rounds in which they may: a round reads all links once.
TOGETHER_SOURCES, SEARCH_ROUNDS = 64, 64

#: A frontier is small if its links are fewer than one in so many.
SMALL_FRONTIER = 8

#: Pairs of sources and nodes that exact betweenness of a large graph may hold as state.
MOST_PAIRS = 10**12

#: Pairs of sources and nodes that are walked by joins at once: what the rounds' files hold; and visits of links that a task should make.
PAIRS_AT_ONCE, VISITS = 50_000_000, 500_000_000


def dependencies(sources: np.ndarray, first: np.ndarray, to: np.ndarray, n: int, leaves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the sources of each node's dependency (Brandes, 2001) and of its square, all sources level by level at once.

    Nodes are 0..n-1; node v pays to[first[v]:first[v + 1]], and leaves[v] more that are not among the nodes. A level visits only the links
    of its frontier, so each link is visited once a source in either direction. Memory: some arrays of sources x (nodes + links).
    """
    cells, many = len(sources) * n, np.diff(first)
    paths, met = np.zeros(cells), np.zeros(cells, bool)
    here = at = np.arange(len(sources)) * n + sources
    paths[at], met[at] = 1.0, True
    levels = []
    while len(here):
        v = here % n
        links = many[v]
        behind = np.repeat(np.arange(len(here)), links)
        link = np.arange(len(behind)) + (first[v] - np.cumsum(links) + links)[behind]
        on = to[link] + (here - v)[behind]
        new = np.flatnonzero(~met[on])
        behind, on = behind[new], on[new]
        levels.append((here, behind, on))
        got = np.bincount(on, paths[here][behind])
        here = np.flatnonzero(got)
        paths[here], met[here] = got[here], True
    delta = np.zeros(cells) if leaves is None else met * np.tile(leaves.astype(float), len(sources))
    for here, behind, on in reversed(levels):
        delta[here] += paths[here] * np.bincount(behind, (1 + delta[on]) / paths[on], minlength=len(here))
    delta[at] = 0.0
    delta = delta.reshape(len(sources), n)
    return delta.sum(axis=0), (delta * delta).sum(axis=0)


class Links:
    """Links of nodes 0..n-1 as searches read them: by whom they pay, and by who pays."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, n: int):
        self.n, self.src = n, src  # given in order of dst
        self.begins = np.flatnonzero(np.diff(dst, prepend=-1) != 0)
        self.paid = dst[self.begins]
        self.order = np.argsort(src, kind="stable")
        self.many = np.bincount(src, minlength=n)
        self.first = np.cumsum(self.many) - self.many
        self.to = dst[self.order]
        self.ends = (src[self.order] << 32) | self.to  # both ends of a link as one number, which is picked at once

    def out_of(self, nodes: np.ndarray) -> np.ndarray:
        """Places, in order of src, of the links that nodes pay by."""
        links = self.many[nodes]
        return np.arange(links.sum()) + np.repeat(self.first[nodes] - np.cumsum(links) + links, links)


def rounds_together(sources: np.ndarray, links: Links, most: int = SEARCH_ROUNDS) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """For up to 64 sources, a bit of a word each, and each level from the sources on: the places, in order of src, of the links that lead
    one level on, and for whom. None if some source sees further than most - 1 links.

    A round reads the links of a small frontier, or all links once for all sources.
    """
    n, word = links.n, np.dtype("<u8")
    new, rounds, here = np.zeros(n, word), [], np.unique(sources)
    np.bitwise_or.at(new, sources, np.left_shift(np.uint64(1), np.arange(len(sources), dtype=word)))
    seen, sent, back = new.copy(), np.empty(len(links.src), word), np.empty(len(links.src), word)
    for _ in range(most):
        met = np.zeros(n, word)
        if few := links.many[here].sum() * SMALL_FRONTIER < len(sent):
            link = links.out_of(here)
            on, words = links.to[link], np.repeat(new[here], links.many[here])
            order = np.argsort(on, kind="stable")
            begins = np.flatnonzero(np.diff(on[order], prepend=-1) != 0)
            if len(link):
                met[on[order[begins]]] = np.bitwise_or.reduceat(words[order], begins)
        else:
            met[links.paid] = np.bitwise_or.reduceat(np.take(new, links.src, out=sent, mode="clip"), links.begins)
        met &= ~seen
        here = np.flatnonzero(met != 0)
        if not len(here):
            return rounds
        if few:
            words &= met[on]
        else:
            words = np.repeat(new, links.many)
            words &= np.take(met, links.to, out=back, mode="clip")
        some = np.flatnonzero(words != 0)
        rounds.append((link[some] if few else some, words.take(some, mode="clip")))
        seen |= met
        new = met
    return None


def levels_together(sources: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int, most: int = SEARCH_ROUNDS) -> tuple[np.ndarray, list[np.ndarray]] | None:
    """The same by link and node: which links lead one level on (a word a link), and each node's level in binary (a word a node for each
    digit; of nodes that are reached). Links src -> dst are in order of dst."""
    links = Links(src, dst, n)
    rounds = rounds_together(sources, links, most)
    if rounds is None:
        return None
    word = np.dtype("<u8")
    ahead, digits = np.zeros(len(src), word), [np.zeros(n, word) for _ in range(len(rounds).bit_length())]
    for level, (link, words) in enumerate(rounds, 1):
        ahead[links.order[link]] |= words
        for j, digit in enumerate(digits):
            if level >> j & 1:
                np.bitwise_or.at(digit, links.to[link], words)
    return ahead, digits


def dependencies_together(
    sources: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int, most: int = SEARCH_ROUNDS, leaves: np.ndarray | None = None, links: Links | None = None
) -> tuple[np.ndarray, np.ndarray] | None:
    """What dependencies returns, for up to 64 sources of a graph of few levels, or None where there are more than `most`: levels are
    searched for all sources together, so that each source by itself reads only the links that lead one level on, in the order of levels."""
    links = links or Links(src, dst, n)
    rounds = rounds_together(sources, links, most)
    if rounds is None:
        return None
    total, squares = np.zeros(n), np.zeros(n)
    if not rounds:
        return total, squares
    stops = np.cumsum([len(link) for link, _ in rounds])
    ends = links.ends[np.concatenate([link for link, _ in rounds])]
    words = np.concatenate([word for _, word in rounds]).view(np.uint8).reshape(-1, 8)
    del rounds
    paths, share, one, ends_here = np.zeros(n), np.zeros(n), np.zeros(n), np.ones(n)
    if leaves is not None:
        ends_here += leaves
    for i, source in enumerate(sources):
        if i % 8 == 0:  # links of any of eight sources: the byte of each word that holds their bits
            byte = np.ascontiguousarray(words[:, i // 8])
            some = np.flatnonzero(byte != 0)
            eight, bits, eight_stops = ends.take(some, mode="clip"), byte.take(some, mode="clip"), np.searchsorted(some, stops)
        own = np.flatnonzero((bits & np.uint8(1 << i % 8)) != 0)
        if not len(own):
            continue
        by = eight.take(own, mode="clip")  # clip: no second look at bounds
        on, at = by & 0xFFFFFFFF, [0, *np.searchsorted(own, eight_stops)]
        by >>= 32
        steps = [(by[a:b], on[a:b]) for a, b in zip(at[:-1], at[1:], strict=True) if a < b]
        paths.fill(0.0)
        paths[source] = 1.0
        for x, y in steps:
            np.add.at(paths, y, paths.take(x, mode="clip"))
        # share: (1 + dependency) / paths, which a node sends to all who pay it; without what it was sent itself it is `one`
        np.maximum(paths, 1.0, out=one)
        np.divide(1.0, one, out=one)
        np.multiply(one, ends_here, out=share)
        for x, y in reversed(steps):
            np.add.at(share, x, share.take(y, mode="clip"))
        share -= one
        share *= paths
        share[source] = 0.0
        total += share
        share *= share
        squares += share
    return total, squares


def dependencies_of(sources: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums over any number of sources: 64 together, and by themselves those that see too far for it. Links are in order of dst.

    Nodes that pay no one and are paid by one node alone are left out of the searches: they are met if that node is, so they only add
    to its dependency.
    """
    pays, is_paid = np.bincount(src, minlength=n), np.bincount(dst, minlength=n)
    leaf = (pays[dst] == 0) & (is_paid[dst] == 1)
    leaves, src, dst = np.bincount(src[leaf], minlength=n), src[~leaf], dst[~leaf]
    links = Links(src, dst, n)
    total, squares, chunk = np.zeros(n), np.zeros(n), max(1, min(64, CELLS // max(len(src), 1)))
    for at in range(0, len(sources), TOGETHER_SOURCES):
        part = sources[at : at + TOGETHER_SOURCES]
        found = [dependencies_together(part, src, dst, n, leaves=leaves, links=links)]
        if found[0] is None:
            first = np.append(links.first, len(src))
            found = (dependencies(part[j : j + chunk], first, links.to, n, leaves) for j in range(0, len(part), chunk))
        for sums, of_squares in found:
            total += sums
            squares += of_squares
    return total, squares


def _by_source(sources: DataFrame, links: DataFrame, groups: int) -> DataFrame:
    """(gid, b, b2): dependencies and their squares summed over sources, each group of sources beside a copy of the links; for graphs within the bounds."""

    def of(rows: pa.Table) -> pa.Table:
        src, dst = (rows.column(c).drop_null().to_numpy() for c in ("src", "dst"))
        ids, place = np.unique(np.concatenate([src, dst]), return_inverse=True)
        order = np.argsort(place[len(src) :], kind="stable")
        src, dst = place[: len(src)][order], place[len(src) :][order]
        total, squares = dependencies_of(np.searchsorted(ids, rows.column("s").drop_null().to_numpy()), src, dst, len(ids))
        some = total > 0
        return pa.table({"gid": pa.array(ids[some], pa.int64()), "b": pa.array(total[some], pa.float64()), "b2": pa.array(squares[some], pa.float64())})

    paying = sources.join(links.select(F.col("src").alias("s")).distinct(), "s", "left_semi")
    none = F.lit(None).cast("long")
    dealt = paying.select(F.pmod(F.xxhash64("s"), F.lit(groups)).alias("g"), "s", none.alias("src"), none.alias("dst"))
    copies = links.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"), none.alias("s"), "src", "dst")
    # ranges of g: a task for each group; by hash two groups may meet in one
    rows = dealt.unionByName(copies).repartitionByRange(groups, "g")
    return rows.groupBy("g").applyInArrow(of, "gid long, b double, b2 double").groupBy("gid").agg(F.sum("b").alias("b"), F.sum("b2").alias("b2"))


def _by_levels(sources: DataFrame, links: DataFrame) -> DataFrame:
    """(gid, b, b2): the same by joins, level by level: the frontier (source, node, paths) grows by one link a round; then
    dependencies flow back from the deepest level. The rounds' files are deleted once the sums are written."""
    level = cut(sources.join(links.select(F.col("src").alias("s")).distinct(), "s", "left_semi").select("s", F.col("s").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels, seen = [level], level.select("s", "v")
    while True:
        grown = level.join(links, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(F.sum("paths").alias("paths"))
        level = cut(grown.join(seen, ["s", "v"], "left_anti"), "level")
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("s", "v"))
    total, below, deltas = level.select("v", F.lit(0.0).alias("delta")), None, []
    for i in range(len(levels) - 1, 0, -1):
        here = levels[i]
        if below is None:
            delta = here.select("s", "v", "paths", F.lit(0.0).alias("delta"))
        else:
            w = below.select("s", F.col("v").alias("w"), F.col("paths").alias("pw"), F.col("delta").alias("dw"))
            share = here.join(links, F.col("v") == F.col("src")).join(w, (here["s"] == w["s"]) & (F.col("dst") == F.col("w"))).groupBy(here["s"].alias("s"), "v").agg(F.sum(F.col("paths") / F.col("pw") * (1 + F.col("dw"))).alias("delta"))
            delta = here.join(share, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        below = cut(delta, "delta")
        deltas.append(below)
        total = total.unionByName(below.select("v", "delta"))
    made = cut(total.groupBy(F.col("v").alias("gid")).agg(F.sum("delta").alias("b"), F.sum(F.col("delta") * F.col("delta")).alias("b2")), "dependencies")
    forget(level, *levels, *deltas)
    return made


def _summed(sources: DataFrame, k: int, links: DataFrame, n_links: int, n: int, small_links: int) -> DataFrame:
    """(gid, b, b2) over k sources: a graph of checked size is copied to groups of sources by a shuffle, a larger one walked by
    joins, so many sources at once as keep the files of the rounds at PAIRS_AT_ONCE pairs."""
    if 0 < n_links <= small_links:
        cores = links.sparkSession.sparkContext.defaultParallelism
        return _by_source(sources, links, max(1, min(-(-k // 64), cores * min(4, -(-k * n_links // (cores * VISITS))))))
    batches = max(1, -(-k * n // PAIRS_AT_ONCE))
    made = [_by_levels(sources.where(F.pmod(F.xxhash64("s"), F.lit(batches)) == i), links) for i in range(batches)]
    found = reduce(DataFrame.unionByName, made)
    return found if batches == 1 else found.groupBy("gid").agg(F.sum("b").alias("b"), F.sum("b2").alias("b2"))


def betweenness(net: Network, samples: int | None = None, small_links: int = SMALL_LINKS, seed: int = 42) -> DataFrame:
    """(gid, betweenness): directed, unweighted, ends left out, over (n - 1)(n - 2), n all nodes.

    samples: that many sources only, scaled by n / samples. Without it a large graph of more than MOST_PAIRS pairs of nodes is
    refused: betweenness_within gives what a stated error needs.
    """
    n = net.nodes.count()
    k = n if samples is None else min(samples, n)
    links, seen = cut_and_sum(net.links.select("src", "dst"), "links", n=F.count("*"))
    if samples is None and n * n > MOST_PAIRS and seen["n"] > small_links:
        raise ValueError(f"exact betweenness of {n} nodes would hold {n * n} pairs; use betweenness_within")
    sources = net.nodes.select(F.col("gid").alias("s")) if samples is None else pivots(net, k, seed)
    scale = (1 / ((n - 1) * (n - 2)) if n > 2 else 0.0) * (n / k if k else 0.0)
    found = _summed(sources, k, links, seen["n"], n, small_links)
    return net.nodes.select("gid").join(found, "gid", "left").select("gid", nine(F.coalesce(F.col("b") * scale, F.lit(0.0))).alias("betweenness"))


def betweenness_within(net: Network, error: float = 0.01, sure: float = 0.95, first: int = 64, small_links: int = SMALL_LINKS, seed: int = 42) -> DataFrame:
    """(gid, betweenness, error, samples): betweenness within an error that holds for all nodes at once with the stated
    probability, from as few sources as that takes.

    Progressive sampling: sources are drawn without repeats in the order of their seeded MD5, `first` of them, then as many again as there
    are, and so on. A source's dependencies over n - 2 lie in 0 to 1, so after each round the empirical Bernstein bound (Maurer and
    Pontil, 2009), shared among nodes, sides and rounds, bounds each node's error; rounds end when none is above
    `error`, or with all sources, which is exact: error 0. One round's dependencies are added to those before.
    """
    n = net.nodes.count()
    links, seen = cut_and_sum(net.links.select("src", "dst"), "links", n=F.count("*"))
    drawn = cut(sums_before(_drawn(net, seed), ["h", "s"], place=F.lit(1).cast("long")).select("s", "place"), "drawn")
    rounds = max(1, -(-n // first)).bit_length() + 1
    share = np.log(4 * n * rounds / (1 - sure)) if n else 0.0
    total, done = None, 0
    while True:
        k = min(n, max(first, 2 * done))
        part = _summed(drawn.where((F.col("place") >= done) & (F.col("place") < k)).select("s"), k - done, links, seen["n"], n, small_links)
        total = cut((part if total is None else total.unionByName(part)).groupBy("gid").agg(F.sum("b").alias("b"), F.sum("b2").alias("b2")), "sums")
        mean = lambda c, power: F.coalesce(F.col(c), F.lit(0.0)) / (max(k, 1) * max(n - 2, 1) ** power)  # noqa: B023, E731
        variance = F.greatest(mean("b2", 2) - mean("b", 1) * mean("b", 1), F.lit(0.0)) * (k / max(k - 1, 1))
        bound = F.lit(0.0) if k == n else n / (n - 1) * (F.sqrt(2 * variance * share / k) + 7 * share / (3 * (k - 1)))
        made, worst = cut_and_sum(net.nodes.select("gid").join(total, "gid", "left").select("gid", nine(mean("b", 1) * (n / max(n - 1, 1) if n > 2 else 0.0)).alias("betweenness"), bound.alias("error"), F.lit(k).cast("long").alias("samples")), "within", error=F.max("error"))
        if k == n or worst["error"] <= error:
            return made
        done = k


#: Rounds that are planned together before their result is written; rows that joining steps with steps may make; links of a step.
TOGETHER, STEP_ROWS, LONGEST = 8, 2_000_000, 16


def _longer_steps(share: DataFrame, state: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(shares over steps of several links, sums over all walks shorter than such a step), from shares over single links and
    the start. Steps are doubled, to LONGEST links at most, while joining them with themselves makes at most `limit` rows,
    which is counted first."""
    for _ in range(LONGEST.bit_length() - 1):
        into, out = share.groupBy(F.col("dst").alias("m")).agg(F.count("*").alias("i")), share.groupBy(F.col("src").alias("m")).agg(F.count("*").alias("o"))
        rows = into.join(out, "m").agg(F.sum(F.col("i") * F.col("o"))).first()[0] or 0
        if not 0 < rows <= limit:
            break
        sent = state.join(share, F.col("gid") == F.col("src")).select(F.col("dst").alias("gid"), (F.col("now") * F.col("share")).alias("now"))
        state = cut(state.unionByName(sent).groupBy("gid").agg(F.sum("now").alias("now")), "walks")
        on = share.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("share").alias("then"))
        share = cut(share.join(on, F.col("dst") == F.col("mid")).groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("share") * F.col("then")).alias("share")), "steps")
    return share, state


def pagerank(net: Network, alpha: float = 0.85, tolerance: float = 1e-14, most: int = 10_000, step_rows: int = STEP_ROWS) -> DataFrame:
    """(gid, rank): weighted by cents; nodes that pay nothing spread their rank evenly; isolates included.

    Rank spread evenly only scales all ranks, so it is left out and made up for at the end: what remains is the sum
    over walks of all lengths, each round adding those one step longer. A step is a link, or several where that makes
    few rows. Rounds stop when what they add is below `tolerance` of the whole; after `most` rounds without that an error
    is raised. Sums run by receiver, so a round is one shuffle, and TOGETHER of them are planned at once.
    """
    n = net.nodes.count()
    out = net.edges.groupBy("src").agg(F.sum("cents").alias("total")).where("total > 0")
    paid = cut(net.edges.join(out, "src").select("src", "dst", (alpha * F.col("cents") / F.col("total")).alias("share")), "share")
    paid, start = _longer_steps(paid, net.nodes.select("gid", F.lit(1.0).alias("now")), step_rows)
    # a row from each node to itself carries its sum on, so that a round reads the state once
    own = net.nodes.select(F.col("gid").alias("src"), F.col("gid").alias("dst"), F.lit(0.0).alias("share"), F.lit(1.0).alias("own"))
    share = cut(paid.withColumn("own", F.lit(0.0)).unionByName(own), "share")
    state = cut(start.select("gid", "now", F.col("now").alias("all")), "rank")
    for _ in range(0, most, TOGETHER):
        last = state
        for _ in range(TOGETHER):
            sent = state.join(share, F.col("gid") == F.col("src")).select(F.col("dst").alias("gid"), (F.col("now") * F.col("share")).alias("now"), (F.col("all") * F.col("own")).alias("all"))
            state = sent.groupBy("gid").agg(F.sum("now").alias("now"), (F.sum("all") + F.sum("now")).alias("all"))
        state, seen = cut_and_sum(state, "rank", now=F.sum("now"), all=F.sum("all"))
        forget(last)
        # what further rounds would add is at most now * alpha / (1 - alpha)
        if not n or seen["now"] * alpha / (1 - alpha) <= tolerance * seen["all"]:
            return state.select("gid", (F.col("all") / F.lit(seen["all"] or 1.0)).alias("rank"))
    raise RuntimeError(f"PageRank did not settle in {most} rounds")


#: Steps of a Lanczos cycle: what its vectors' files hold.
CYCLE = 32


def hits(net: Network, weighted: bool = False, tolerance: float = 1e-13, most: int = 10_000) -> DataFrame:
    """(gid, hub, authority): the hubs that power iteration from equal hubs tends to, to where such a step moves them by less than
    `tolerance` (Euclidean, of unit vectors), authorities anew from the last hubs, each L1-normalised; after `most` steps
    without that an error is raised.

    Steps are Lanczos's on hub-to-hub weights: from the same start they span what power iteration passes through, and the best
    vector of that span has its limit after about the square root of the steps. Each step writes one vector; its two sums give the
    small matrix whose first eigenvector combines them. After CYCLE steps the best vector starts anew. Vectors meet links by
    shuffles: none passes the driver.
    """
    top = net.edges.agg(F.max("cents").alias("top"))
    w = (F.col("cents") / F.col("top")) if weighted else F.lit(1.0)
    links = cut(net.edges.crossJoin(F.broadcast(top)).select("src", "dst", w.alias("w")), "hits")  # one row

    def authorities(hub: DataFrame) -> DataFrame:
        return links.join(hub.select("gid", "h").hint("shuffle_hash"), F.col("src") == F.col("gid")).groupBy(F.col("dst").alias("gid")).agg(F.sum(F.col("h") * F.col("w")).alias("a"))

    def power(hub: DataFrame) -> DataFrame:
        back = authorities(hub).withColumnRenamed("gid", "dst")
        return links.join(back.hint("shuffle_hash"), "dst").groupBy(F.col("src").alias("gid")).agg(F.sum(F.col("a") * F.col("w")).alias("h"))

    def stepped(rows: DataFrame) -> tuple[DataFrame, float, float]:
        """Of rows (gid, h, was): with v, the step from h; the length of h, and the step's part along h."""
        v = power(rows).select("gid", F.col("h").alias("v"))
        made, seen = cut_and_sum(rows.join(v.hint("shuffle_hash"), "gid", "left").na.fill(0.0), "hub", hh=F.sum(F.col("h") * F.col("h")), hv=F.sum(F.col("h") * F.col("v")))
        return made, (seen["hh"] or 0.0) ** 0.5, (seen["hv"] / seen["hh"]) if seen["hh"] else 0.0

    hub = cut(power(net.nodes.select("gid", F.lit(1.0).alias("h"))), "hub")
    done, steps = links.isEmpty(), 0
    while not done:
        if steps >= most:
            raise RuntimeError(f"HITS did not settle in {most} rounds")
        rows, length, along = stepped(hub.select("gid", "h", F.lit(0.0).alias("was")))
        vectors, lengths, diagonal = [rows], [length], [along]
        if not length:  # no weight anywhere
            break
        for _ in range(CYCLE):
            steps += 1
            was = F.col("was") * (lengths[-1] / lengths[-2]) if len(lengths) > 1 else F.lit(0.0)
            nxt = (F.col("v") - F.col("h") * diagonal[-1]) / lengths[-1] - was
            rows, length, along = stepped(vectors[-1].select("gid", nxt.alias("h"), F.col("h").alias("was")))
            values, best = np.linalg.eigh(np.diag(diagonal) + np.diag(lengths[1:], 1) + np.diag(lengths[1:], -1))
            best = best[:, -1] * (np.sign(best[0, -1]) or 1.0)
            done = bool(length * abs(best[-1]) < tolerance * values[-1])  # how far a power step would move the best vector
            if done or len(vectors) == CYCLE:
                forget(rows)
                break
            vectors, lengths, diagonal = [*vectors, rows], [*lengths, length], [*diagonal, along]
        parts = reduce(DataFrame.unionByName, [x.select("gid", (F.col("h") * float(y / n)).alias("h")) for x, y, n in zip(vectors, best, lengths, strict=True)])
        last, hub = hub, cut(parts.groupBy("gid").agg(F.greatest(F.sum("h"), F.lit(0.0)).alias("h")), "hub")  # no part of the limit is below 0
        forget(last, *vectors)
    last, hub = hub, cut(power(hub), "hub")
    forget(last)
    scaled = lambda df, c: df.crossJoin(F.broadcast(df.agg(F.sum(c).alias("all")))).select("gid", F.when(F.col("all") > 0, F.col(c) / F.col("all")).otherwise(0.0).alias(c))
    rows = net.nodes.select("gid").join(scaled(hub.select("gid", "h"), "h"), "gid", "left").join(scaled(authorities(hub), "a"), "gid", "left").na.fill(0.0)
    return rows.select("gid", six(F.col("h")).alias("hub"), six(F.col("a")).alias("authority"))
