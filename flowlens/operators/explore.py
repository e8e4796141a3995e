"""Questions about a selection of nodes: search, key figures, pages, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.operators.roles import ROLES
from flowlens.sources.tables import Network


def search(rows: DataFrame, text: str = "", role: str | None = None, cluster: int | None = None) -> DataFrame:
    """Rows (gid, role, cluster_id, depth, ...) that hold text in gid, role or, if the rows have it, evidence; "depth=4" asks for a depth."""
    found = rows
    text = text.strip().lower()
    if text.startswith("depth="):
        found = found.where(F.col("depth") == int(text[6:]))
    elif text:
        said = F.lower("evidence").contains(text) if "evidence" in rows.columns else F.lit(False)
        found = found.where(F.col("gid").cast("string").contains(text) | F.lower("role").contains(text) | said)
    if role:
        found = found.where(F.col("role") == role)
    return found.where(F.col("cluster_id") == cluster) if cluster is not None else found


def inside(net: Network, chosen: DataFrame) -> DataFrame:
    """Edges whose two ends are chosen. chosen: (gid)."""
    ids = chosen.select("gid")
    return net.edges.join(ids, F.col("src") == F.col("gid"), "left_semi").join(ids, F.col("dst") == F.col("gid"), "left_semi")


def key_figures(net: Network, chosen: DataFrame) -> DataFrame:
    """One row: nodes, seeds, clusters, edges among them, their transactions and turnover. chosen: (gid, is_seed, cluster_id)."""
    a = chosen.agg(F.count("*").alias("n_nodes"), F.sum(F.col("is_seed").cast("long")).alias("n_seeds"), F.count_distinct("cluster_id").alias("n_clusters"))
    return a.crossJoin(inside(net, chosen).agg(F.count("*").alias("n_edges"), F.sum("n_tx").alias("n_tx"), F.sum("cents").alias("cents")))


def role_mix(rows: DataFrame) -> DataFrame:
    total = rows.agg(F.count("*").alias("all"))
    return rows.groupBy("role").agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("role", "n", (F.rint(F.col("n") / F.col("all") * 1e6) / 1e6).alias("share"))


def transaction_page(net: Network, gid: int, offset: int = 0, limit: int = 100) -> DataFrame:
    """A node's transactions in order of day, partner and amount, from offset on; limit 1 to 500."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1 to 500 and offset not negative")
    return net.tx.where((F.col("src") == gid) | (F.col("dst") == gid)).orderBy("day", "src", "dst", "cents").offset(offset).limit(limit)


def table_page(rows: DataFrame, by: str = "priority_score", descending: bool = True, page: int = 0, size: int = 20) -> DataFrame:
    order = F.desc(by) if descending else F.asc(by)
    return rows.orderBy(order, "gid").offset(page * size).limit(size)


def neighbours(net: Network, gid: int, most: int = 25) -> DataFrame:
    """(other, side, cents): a node's largest edges."""
    a = net.links.where(F.col("src") == gid).select(F.col("dst").alias("other"), F.lit("out").alias("side"), "cents")
    b = net.links.where(F.col("dst") == gid).select(F.col("src").alias("other"), F.lit("in").alias("side"), "cents")
    return a.unionByName(b).orderBy(F.desc("cents"), "other", "side").limit(most)


def scene(net: Network, rows: DataFrame, most: int = 150) -> DataFrame:
    """Edges among the first nodes by priority."""
    return inside(net, rows.orderBy(F.desc("priority_score"), "gid").limit(most))


#: What a record of an imported snapshot must hold: name, type, condition on a value that is there.
RECORD = (
    ("gid", "string", "gid rlike '^[0-9]+$'"), ("role", "string", f"role in {(*ROLES, 'peripheral')}"), ("date", "string", "date rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' and try_to_date(date, 'yyyy-MM-dd') is not null"),
    ("role_score", "double", "role_score between 0 and 1"), ("priority_score", "double", "priority_score between 0 and 1"), ("in_cents", "double", "in_cents >= 0 and not isnan(in_cents)"), ("n_tx", "double", "n_tx >= 0 and n_tx = floor(n_tx) and n_tx <= 9007199254740991"),
)


def normalised(lines: DataFrame) -> DataFrame:
    """(record, faults) of JSON lines (value): the typed record and the names of fields that break a rule of RECORD.

    Ids are texts of digits; a number that is longer than a double holds keeps its digits, as JSON is read into text
    first. Fields that are absent stay absent (null); gid must be there. A line that is no JSON object has the fault "json".
    """
    names = ", ".join(f"{n} string" for n, _, _ in RECORD)
    row = lines.select(F.from_json("value", names, {"mode": "PERMISSIVE"}).alias("r"), (F.try_parse_json("value").isNull() | ~F.col("value").rlike(r"^\s*\{")).alias("broken"))
    typed = row.select("broken", "r.*").select("broken", *[F.expr(f"try_cast({n} as {t})").alias(n) for n, t, _ in RECORD], *[F.col(n).alias(f"_{n}") for n, _, _ in RECORD])
    fault = lambda n, rule: F.when(F.col(f"_{n}").isNotNull() & ~F.coalesce(F.expr(rule), F.lit(False)), F.lit(n))
    faults = F.array_compact(F.array(F.when(F.col("broken"), F.lit("json")), F.when(F.col("_gid").isNull(), F.lit("gid")), *[fault(n, rule) for n, _, rule in RECORD]))
    return typed.select(F.struct(*[n for n, _, _ in RECORD]).alias("record"), faults.alias("faults"))
