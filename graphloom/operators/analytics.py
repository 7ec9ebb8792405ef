"""Graph analytics over nodes (id, name, label) and edges (id, source, target, rel_type)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.betweenness import whole_graph_scores
from graphloom.operators.traverse import bfs, distances
from graphloom.runtime import cut

# Relationship types that give control of a computer.
ADMIN_TYPES = ["AdminTo", "GenericAll", "GenericWrite", "Owns", "WriteDacl", "WriteOwner", "AllExtendedRights", "ForceChangePassword", "AddMember"]
SEARCH_ORDER = ["Domain", "User", "Group", "Computer"]
WHOLE_GRAPH = 12_000_000  # edges (undirected ones twice) up to which betweenness gives the whole graph to every task


def oriented(edges: DataFrame, directed: bool) -> DataFrame:
    """id, src, dst; for undirected graphs both ways."""
    out = edges.select("id", F.col("source").alias("src"), F.col("target").alias("dst")).where("src is not null and dst is not null")
    return out if directed else out.unionByName(edges.select("id", F.col("target").alias("src"), F.col("source").alias("dst")).where("src <> dst"))


def edge_betweenness(nodes: DataFrame, edges: DataFrame, directed: bool = True, types: list[str] | None = None, sample: int = 100) -> DataFrame:
    """id, source, target, rel_type, score of every edge (Brandes, unweighted; parallel edges count apart).

    Exact for at most ``sample`` nodes, else from ``sample`` sources (the first by hash, the same in every run) scaled to
    all. Up to WHOLE_GRAPH edges, tasks that hold the graph share the sources; a larger graph stays distributed, with a
    row for every pair of source and node."""
    edges = edges if types is None else edges.where(F.col("rel_type").isin(*types))
    n = nodes.count()
    chosen = nodes.select(F.col("id").alias("s"))
    if n > sample:
        chosen = chosen.orderBy(F.xxhash64("s"), "s").limit(sample)
    scale = n / sample if n > sample else 1.0
    one = lambda c: F.xxhash64(F.col(c).cast("string"))
    two = lambda c: F.hash(F.col(c).cast("string")).cast("bigint")
    check = F.shiftleft(two("src"), 32).bitwiseOR(two("dst").bitwiseAND(F.lit(0xFFFFFFFF)))
    hashed = oriented(edges, directed).select("id", one("src").alias("src"), one("dst").alias("dst"), check.alias("check")).persist()
    try:
        total = None
        if hashed.count() <= WHOLE_GRAPH:
            total = whole_graph_scores(hashed, [r.h for r in chosen.where("s is not null").select(one("s").alias("h")).collect()])
    finally:
        hashed.unpersist()
    if total is None:
        total = _scores_by_rows(chosen, oriented(edges, directed))
    ends = edges.select("id", "source", "target", "rel_type")
    if total is None:
        return ends.withColumn("score", F.lit(0.0))
    total = total.groupBy("id").agg((F.sum("c") * scale / (1 if directed else 2)).alias("score"))
    return ends.join(total, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _scores_by_rows(chosen: DataFrame, hops: DataFrame) -> DataFrame | None:
    """id, c: all sources advance together, one level a round: path counts are summed forward, dependencies backward."""
    hops = cut(hops)
    frontier = cut(chosen.select("s", F.col("s").alias("v"), F.lit(1.0).alias("sigma")))
    seen, steps = frontier.select("s", F.col("v").alias("w")), []
    while True:
        step = frontier.join(hops, F.col("v") == F.col("src")).select("s", "v", F.col("dst").alias("w"), "id", F.col("sigma").alias("sigma_v"))
        step = cut(step.join(seen, ["s", "w"], "left_anti"))
        frontier = cut(step.groupBy("s", "w").agg(F.sum("sigma_v").alias("sigma")).select("s", F.col("w").alias("v"), "sigma"))
        if not frontier.limit(1).count():
            break
        steps.append((step, frontier))
        seen = seen.unionByName(frontier.select("s", F.col("v").alias("w")))
        if len(steps) % 8 == 0:
            seen = cut(seen)
    delta, scores = None, []
    for step, reached in reversed(steps):
        low = reached.select("s", F.col("v").alias("w"), F.col("sigma").alias("sigma_w"))
        low = low.withColumn("delta", F.lit(0.0)) if delta is None else low.join(delta, ["s", "w"], "left").select("s", "w", "sigma_w", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        part = cut(step.join(low, ["s", "w"]).select("s", "v", "id", (F.col("sigma_v") / F.col("sigma_w") * (1 + F.col("delta"))).alias("c")))
        delta = part.groupBy("s", F.col("v").alias("w")).agg(F.sum("c").alias("delta"))
        scores.append(part.groupBy("id").agg(F.sum("c").alias("c")))
    if not scores:
        return None
    total = scores[0]
    for s in scores[1:]:
        total = total.unionByName(s)
    return total


def above_threshold(scores: DataFrame, least: float) -> DataFrame:
    """The edges whose score is at least ``least``."""
    return scores.where(F.col("score") >= least)


def choke_points(nodes: DataFrame, scores: DataFrame, top: int = 50, expected: list[str] | None = None) -> DataFrame:
    """The edges with the highest scores above 0, with names and labels of their ends; with ``expected``, only those whose
    source has none of these labels (the choke points one wouldn't expect)."""
    best = scores.where("score > 0")
    if expected is not None:
        usual = nodes.where(F.col("label").isin(*expected)).select(F.col("id").alias("source"))
        best = best.join(usual, "source", "left_anti")
    best = best.orderBy(F.desc("score"), "id").limit(top)
    for end in ("source", "target"):
        names = nodes.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"), F.col("label").alias(f"{end}_label"))
        best = best.join(names, end, "left")
    return best


def connected_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """id, component: the smallest id that can be reached when directions are ignored.

    Alternating large-star and small-star steps: the number of rounds grows with the logarithm of the component size, not
    with its diameter, and neighbourhoods are only ever reduced to a minimum (map-side), never collected."""
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a is not null and b is not null and a <> b")
    pairs = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def star(df: DataFrame, both: bool) -> DataFrame:
        around = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else df
        low = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = around.join(low, "u")
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if both else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    mark = None
    while True:
        pairs = cut(star(star(pairs, True), False))
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark:
            break
        mark = now
    found = pairs.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = found.select("component").distinct().select(F.col("component").alias("id"), "component")
    found = found.unionByName(roots)
    if nodes is None:
        return found
    return nodes.select("id").join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def reaching(edges: DataFrame, seeds: DataFrame, types: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """node, hops: who can reach a seed (``seeds``: node), at its least number of hops; the seeds themselves at 0."""
    some = edges if types is None else edges.where(F.col("rel_type").isin(*types))
    some = some if not without else some.where(~F.col("rel_type").isin(*without))
    return distances(some.select(F.col("target").alias("src"), F.col("source").alias("dst")), seeds)


def members_of(nodes: DataFrame, edges: DataFrame, groups: DataFrame, label: str | None = None) -> DataFrame:
    """id, name, label, hops: who is a member of one of the groups (``groups``: node), directly or through other groups."""
    found = reaching(edges, groups, ["MemberOf"]).where("hops > 0")
    some = nodes if label is None else nodes.where(F.col("label") == label)
    return some.select("id", "name", "label").join(found.withColumnRenamed("node", "id"), "id")


def memberships(nodes: DataFrame, edges: DataFrame, ident: str, suffix: str = "") -> DataFrame:
    """id, name, hops: the groups a node is in, directly or through others, with an id that ends with ``suffix``."""
    member = edges.where("rel_type = 'MemberOf'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    seed = edges.sparkSession.createDataFrame([(ident,)], "node string")
    found = distances(member, seed).where((F.col("hops") > 0) & F.col("node").endswith(suffix)).select(F.col("node").alias("id"), "hops")
    return found.join(nodes.select("id", "name"), "id", "left").select("id", "name", "hops")


def is_member_of(edges: DataFrame, ident: str, group: str) -> bool:
    """Whether a node is in a group, directly or through others; a node is no member of itself."""
    member = edges.where("rel_type = 'MemberOf'").select(F.col("source").alias("src"), F.col("target").alias("dst"))
    spark = edges.sparkSession
    pair = spark.createDataFrame([(ident, group)], "seed string, node string")
    return bool(bfs(member, pair.select("seed"), high=1_000_000, pairs=pair).limit(1).count())


def shortest_path(nodes: DataFrame, edges: DataFrame, source: str, target: str, types: list[str] | None = None) -> DataFrame:
    """step, id, name, label, rel_type (of the edge that leads to the node; null for the first): one shortest path, or no
    rows. Among paths of equal length the one with the smallest edge ids."""
    some = edges if types is None else edges.where(F.col("rel_type").isin(*types))
    hops = some.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.struct("id", "rel_type").alias("rel"))
    pair = edges.sparkSession.createDataFrame([(source, target)], "seed string, node string")
    path = bfs(hops, pair.select("seed"), high=1_000_000, paths=True, pairs=pair)
    steps = path.select(F.posexplode("nodes").alias("step", "id"), "rels").select("step", "id", F.when(F.col("step") > 0, F.try_element_at("rels", F.greatest("step", F.lit(1)))["rel_type"]).alias("rel_type"))
    return steps.join(nodes.select("id", "name", "label"), "id", "left").select("step", "id", "name", "label", "rel_type")


def reach_report(nodes: DataFrame, edges: DataFrame, suffix: str = "-512", label: str = "User") -> DataFrame:
    """One row: nodes of the label, those that reach a group with the id suffix by membership, and by any edge."""
    seeds = nodes.where(F.col("id").endswith(suffix)).select(F.col("id").alias("node"))
    mine = nodes.where(F.col("label") == label).select(F.col("id").alias("node"))
    by_member = mine.join(reaching(edges, seeds, ["MemberOf"]), "node").agg(F.count("*").alias("n_member"))
    by_any = mine.join(reaching(edges, seeds), "node").agg(F.count("*").alias("n_any"), F.max("hops").alias("most_hops"))
    return mine.agg(F.count("*").alias("n_nodes")).crossJoin(by_member).crossJoin(by_any)  # one row each


def out_neighbours(edges: DataFrame, without: str = "MemberOf") -> DataFrame:
    """source, n_targets: distinct targets over edges of other types."""
    return edges.where(F.col("rel_type") != without).groupBy("source").agg(F.count_distinct("target").alias("n_targets"))


def degree_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """For every node the numbers of distinct neighbours: incoming, outgoing, member_of, members, admin_to (computers)."""
    computers = nodes.where("label = 'Computer'").select(F.col("id").alias("target"), F.lit(True).alias("is_computer"))
    out = edges.join(computers, "target", "left").groupBy(F.col("source").alias("id")).agg(
        F.count_distinct("target").alias("outgoing"),
        F.count_distinct(F.when(F.col("rel_type") == "MemberOf", F.col("target"))).alias("member_of"),
        F.count_distinct(F.when(F.col("rel_type").isin(*ADMIN_TYPES) & F.col("is_computer"), F.col("target"))).alias("admin_to"),
    )
    into = edges.groupBy(F.col("target").alias("id")).agg(F.count_distinct("source").alias("incoming"), F.count_distinct(F.when(F.col("rel_type") == "MemberOf", F.col("source"))).alias("members"))
    counts = ["incoming", "outgoing", "admin_to", "member_of", "members"]
    return nodes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts))


def connections(edges: DataFrame, ident: str, direction: str = "any") -> DataFrame:
    """Edges of one node: incoming, outgoing, admin, memberof, members or any."""
    into, out, member = F.col("target") == ident, F.col("source") == ident, F.col("rel_type") == "MemberOf"
    conditions = {"incoming": into, "outgoing": out, "admin": out & F.col("rel_type").isin(*ADMIN_TYPES), "memberof": out & member, "members": into & member, "any": into | out}
    if direction not in conditions:
        raise ValueError(f"unknown direction {direction}")
    return edges.where(conditions[direction])


def edges_between(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are among ``ids`` (id)."""
    some = ids.select("id").distinct()
    return edges.join(some.withColumnRenamed("id", "source"), "source", "left_semi").join(some.withColumnRenamed("id", "target"), "target", "left_semi")


def search(nodes: DataFrame, text: str, limit: int = 50) -> DataFrame:
    """Nodes whose name or id holds the text (letters compared without case), by label, then name."""
    if len(text) < 2:
        return nodes.where(F.lit(False))
    rank = F
    for i, label in enumerate(SEARCH_ORDER):
        rank = rank.when(F.col("label") == label, i)
    hit = F.lower("name").contains(text.lower()) | F.lower("id").contains(text.lower())
    return nodes.where(hit).orderBy(rank.otherwise(len(SEARCH_ORDER)), F.lower("name"), "id").limit(limit)


def resolve(nodes: DataFrame, identifier: str) -> DataFrame:
    """The node with this id, else one with this name."""
    hit = nodes.where((F.col("id") == identifier) | (F.col("name") == identifier))
    return hit.orderBy((F.col("id") == identifier).desc(), "id").limit(1)


def label_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind (node or relationship), name, n."""
    a = nodes.groupBy(F.lit("node").alias("kind"), F.col("label").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(edges.groupBy(F.lit("relationship").alias("kind"), F.col("rel_type").alias("name")).agg(F.count("*").alias("n")))


def upsert_nodes(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Nodes of both by id; a new value that is not null wins, of several new rows the last by ``order``."""
    props = [c for c in new.columns if c not in ("id", order)]
    last = new.groupBy("id").agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"new_{c}") for c in props))
    joined = old.join(last, "id", "full")
    keep = [F.coalesce(f"new_{c}", c).alias(c) if c in old.columns else F.col(f"new_{c}").alias(c) for c in props]
    return joined.select("id", *keep, *(c for c in old.columns if c not in ("id", *props)))


def upsert_properties(old: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Nodes (id, labels array, properties map of texts) with new ones merged in, in order.

    A property is what the last row that names it says, null removing it; labels are united; ``placeholder`` stays only if
    the last row of a node has it. Rows without an id are nodes of their own. Rows of one node meet only by property, after
    a partial maximum in the scan, so a node that is loaded very often is no hot group."""
    columns = ["id", "labels", "properties"]
    every = old.select(*columns, F.lit(None).cast(new.schema[order].dataType).alias("o"), F.lit(0).alias("turn")).unionByName(new.select(*columns, F.col(order).alias("o"), F.lit(1).alias("turn")))
    alone = every.where("id is null").select(*columns)
    some = every.where("id is not null")
    place = F.struct("turn", "o")
    fields = some.select("id", place.alias("at"), F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by(F.struct("v"), "at").alias("last"))
    whole = some.groupBy("id").agg(F.max_by(F.coalesce(F.lower(F.col("properties")["placeholder"]) == "true", F.lit(False)), place).alias("open"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("labels")))).alias("labels"))
    kept = fields.where("last.v is not null and k <> 'placeholder'").groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", F.col("last.v").alias("v"))))).alias("properties"))
    none = F.expr("cast(map() as map<string,string>)")
    merged = whole.join(kept, "id", "left").withColumn("properties", F.coalesce("properties", none))
    own = F.when(F.col("open"), F.map_concat("properties", F.create_map(F.lit("placeholder"), F.lit("true")))).otherwise(F.col("properties"))
    return merged.select("id", "labels", own.alias("properties")).unionByName(alone)


def insert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges of both; of equal (source, target, rel_type) the first stays."""
    key = ["source", "target", "rel_type"]
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)
