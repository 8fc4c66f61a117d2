"""Graph operators over ``src, dst, relationship, seq`` edge tables: incident edges, BFS, paths, beams, cross-repo links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.scratch import SMALL_ROWS, materialize, small

# What an edge is worth, by its relationship.
PRIORS = {
    "gloss": 0.9,
    "exposes": 0.85,
    "calls": 0.8,
    "tested_by": 0.8,
    "inherits": 0.65,
    "contains": 0.4,
    "references": 0.25,
    "imports": 0.5,
    "shared_import": 0.3,
    "shared_entity": 0.3,
    "depends_on": 0.35,
}
OTHER, DECAY, TESTED_BACK, CONTAINS_OUT = 0.2, 0.85, 0.35, 0.55
#: Nodes of a beam that are broadcast at most; beams of more read all edges once.
BROADCAST_NODES = 200_000


def last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each pair: the one with the greatest ``seq``."""
    return edges.groupBy("src", "dst").agg(F.max_by("relationship", F.struct("seq", "relationship")).alias("relationship"))


def known_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends are nodes."""
    ids = nodes.select("entity_id").distinct()
    return edges.join(ids, edges["src"] == ids["entity_id"], "left_semi").join(ids, edges["dst"] == ids["entity_id"], "left_semi")


def incident(edges: DataFrame) -> DataFrame:
    """``node, other, relationship, incoming``: every edge from both of its ends."""
    out = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "relationship", F.lit(False).alias("incoming"))
    return out.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "relationship", F.lit(True).alias("incoming")))


def degree(edges: DataFrame) -> DataFrame:
    """``node, degree`` over edges and their reverses, pre-aggregated map-side so that hubs don't skew it."""
    return incident(edges).groupBy("node").agg(F.count("*").alias("degree"))


def top_degree(edges: DataFrame, n: int) -> DataFrame:
    return degree(edges).orderBy(F.col("degree").desc(), "node").limit(n)


def bfs(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """``seed, node, hops``: nodes reached over out-edges in at most ``depth`` hops, the seed itself left out. The hops are unrolled: a
    frontier join each, against what was visited."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct()
    seen = seeds.select(F.col("entity_id").alias("seed"), F.col("entity_id").alias("node"), F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, depth + 1):
        new = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        frontier = new.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def shortest_path(edges: DataFrame, pairs: DataFrame, depth: int | None = None) -> DataFrame:
    """``start, goal, hops, path`` (``>``-joined) for pairs that out-edges connect; of equal paths the least. ``depth``: most hops, if given.

    The search goes back from the goals, so that starts of one goal share its steps: a hop joins the edges with the nodes that it came to last, those alone
    that edges lead to. Each hop is written out so that plans stay short. It ends when no goal moves on or, if pairs are few, has none left to find.
    """
    step = edges.select("src", "dst")
    wanted = materialize(pairs.select("start", "goal").distinct(), "pairs")
    few = wanted.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    ends = materialize(step.select(F.col("dst").alias("node")).distinct(), "ends")
    front = materialize(wanted.select("goal", F.col("goal").alias("node"), F.col("goal").cast("string").alias("path"), F.lit(0).alias("hops")).distinct(), "front")
    seen = front
    hop = 0
    while depth is None or hop < depth:
        hop += 1
        live = front.join(ends, "node", "left_semi")
        if few:
            found = seen.select("goal", F.col("node").alias("start"))
            live = live.join(F.broadcast(wanted.join(found, ["start", "goal"], "left_anti").select("goal").distinct()), "goal", "left_semi")
        live = materialize(live.select("goal", F.col("node").alias("dst"), "path"), "live")
        if live.isEmpty():
            break
        moved = small(live).join(step, "dst").select("goal", F.col("src").alias("node"), F.concat_ws(">", F.col("src").cast("string"), "path").alias("path"))
        moved = moved.groupBy("goal", "node").agg(F.min("path").alias("path")).join(seen.select("goal", "node"), ["goal", "node"], "left_anti")
        front = materialize(moved.select("goal", "node", "path", F.lit(hop).alias("hops")), "front")
        seen = seen.unionByName(front)
    return wanted.join(seen.withColumnRenamed("node", "start"), ["start", "goal"]).select("start", "goal", "hops", "path")


def nearest(sides: DataFrame, most: int) -> DataFrame:
    """``node, lists``: the first ``most`` neighbours by id of each node over each relationship and direction (and apart, files and others)."""
    group = ["node", "relationship", "incoming", "to_file"]
    first = Window.partitionBy(*group).orderBy("other")
    rows = sides.withColumn("_n", F.dense_rank().over(first)).where(F.col("_n") <= most)
    each = rows.groupBy(*group).agg(F.array_sort(F.collect_set("other")).alias("others"))
    return each.groupBy("node").agg(F.collect_list(F.struct("relationship", "incoming", "to_file", "others")).alias("lists"))


def expand_beam(edges: DataFrame, seeds: DataFrame, width: int = 6, depth: int = 2, most: int = 6, nodes: DataFrame | None = None) -> DataFrame:
    """``seeds``: ``query_id, entity_id, score``. Returns ``query_id, entity_id, score, hop`` of the accepted nodes.

    Candidates are accepted by falling score (then id, then relationship): up to ``max(2, width // 3)`` of a relationship and ``width`` in a hop, ``most``
    over all hops. A node turned away for one relationship may still come in by another. A candidate's score is its edge's prior times its origin's score
    times ``DECAY`` for each hop before; incoming ``tested_by`` counts ``TESTED_BACK`` at most unless a seed of the query is a test, outgoing ``contains``
    ``CONTAINS_OUT`` at least. ``nodes`` (``entity_id, type, file_path``) tells files, which are passed over unless a seed is one, and tests.

    All neighbours of a node over one relationship and direction score the same. Of those that the query hasn't seen, no more can be accepted than the hop has
    places, so the first of them by id are all that a hop looks at, however large a hub is. A row carries what its query has seen, and a hop is one join and one
    aggregation of short lists.
    """
    prior = lambda r: reduce(lambda acc, kv: acc.when(r == kv[0], kv[1]), PRIORS.items(), F.when(F.lit(False), 0.0)).otherwise(OTHER)
    start = seeds.select("query_id", F.col("entity_id").alias("node"), "score")
    sides = lambda e: incident(e).withColumn("to_file", F.lit(False))
    file, test = F.lit(True), F.lit(False)
    if nodes is not None:
        known = nodes.select(F.col("entity_id").alias("node"), (F.col("type") == "file").alias("_file"), F.regexp_replace(F.coalesce("file_path", F.lit("")), r"\\", "/").alias("_p"))
        start = start.join(known, "node")
        file, test = F.col("_file"), F.contains("_p", F.lit("/test")) | F.startswith("_p", F.lit("tests/"))
        sides = lambda e: incident(e).join(known.select(F.col("node").alias("other"), F.col("_file").alias("to_file")), "other")
    beam = F.collect_list(F.struct("node", "score")).alias("beam")
    state = start.groupBy("query_id").agg(beam, F.collect_set("node").alias("seen"), F.max(file).alias("from_file"), F.max(test).alias("from_test"), F.lit(0).alias("added"))
    state = materialize(state, "beam")
    begun = state.agg(F.max(F.size("seen")).alias("seen"), F.sum(F.size("beam")).alias("rows")).first()
    longest = min(width, most) + (begun["seen"] or 0) + most
    few = (begun["rows"] or 0) * max(width, 1) <= BROADCAST_NODES
    edges = edges.select("src", "dst", "relationship")
    if few:
        edges = materialize(edges, "edges")
    else:
        lists = materialize(nearest(sides(edges), longest), "lists")
    kinds = {f.name: f.dataType.simpleString() for f in start.schema}
    each = f"struct<fall: double, other: {kinds['node']}, relationship: string>"
    found = None
    for hop in range(depth):
        front = state.where(F.col("added") < most).select("query_id", F.explode("beam").alias("_b"), "seen", "from_file", "from_test", "added").select("query_id", "_b.*", "seen", "from_file", "from_test", "added")
        if few:
            at = F.broadcast(front.select("node").distinct())
            near = edges.join(at, edges["src"] == at["node"], "left_semi").unionByName(edges.join(at, edges["dst"] == at["node"], "left_semi"))
            lists = nearest(sides(near).join(at, "node", "left_semi"), longest)
        places = F.least(F.lit(width), F.lit(most) - F.col("added"))

        def candidates(g: Column) -> Column:
            back, out_of = g["incoming"] & (g["relationship"] == "tested_by"), ~g["incoming"] & (g["relationship"] == "contains")
            plain = prior(g["relationship"])
            weight = F.when(back & ~F.col("from_test"), F.least(plain, F.lit(TESTED_BACK))).when(out_of, F.greatest(plain, F.lit(CONTAINS_OUT))).otherwise(plain)
            fall = -F.round(weight * F.col("score") * DECAY**hop, 9)
            new = F.slice(F.filter(g["others"], lambda o: ~F.array_contains("seen", o)), F.lit(1), places)
            return F.transform(new, lambda o: F.struct(fall.alias("fall"), o.alias("other"), g["relationship"].alias("relationship")))

        groups = F.filter("lists", lambda g: F.col("from_file") | ~g["to_file"])
        rows = front.join(lists, "node").select("query_id", F.flatten(F.transform(groups, candidates)).alias("c"), "seen", "from_file", "from_test", "added").where(F.size("c") > 0)
        carried = [F.first(c).alias(c) for c in ("seen", "from_file", "from_test", "added")]
        offered = rows.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("c"), *carried)

        def accept(out: Column, x: Column) -> Column:
            free = ~F.exists(out, lambda o: o["other"] == x["other"]) & (F.size(F.filter(out, lambda o: o["relationship"] == x["relationship"])) < max(2, width // 3))
            return F.when(free & (F.size(out) < width) & (F.col("added") + F.size(out) < most), F.concat(out, F.array(x))).otherwise(out)

        taken = offered.withColumn("t", F.aggregate("c", F.array().cast(f"array<{each}>"), accept)).where(F.size("t") > 0)
        state = materialize(
            taken.select(
                "query_id", F.transform("t", lambda x: F.struct(x["other"].alias("node"), (-x["fall"]).alias("score"))).alias("beam"), F.concat("seen", F.transform("t", lambda x: x["other"])).alias("seen"),
                "from_file", "from_test", (F.col("added") + F.size("t")).alias("added"),
            ),
            "beam",
        )
        step = state.select("query_id", F.explode("beam").alias("_b")).select("query_id", F.col("_b.node").alias("entity_id"), F.col("_b.score").alias("score"), F.lit(hop + 1).alias("hop"))
        found = step if found is None else found.unionByName(step)
    return found


def entity_summary(edges: DataFrame, most: int = 10) -> DataFrame:
    """``node, neighbors`` (the first ``most`` out-neighbours by id, comma-joined), ``n``."""
    order = Window.partitionBy("src").orderBy("dst")
    rows = edges.select("src", "dst").distinct().withColumn("_n", F.row_number().over(order))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", "dst")))), lambda s: s["dst"].cast("string")), ",")
    return rows.groupBy(F.col("src").alias("node")).agg(listed.alias("neighbors"), F.count("*").alias("n"))


def shared_between(items: DataFrame, group: str, item: str) -> DataFrame:
    """``a, b, n``: pairs of groups (``a < b``) and how many items they share. One row for each group and item goes into the join."""
    rows = items.select(F.col(group).alias("g"), F.col(item).alias("i")).distinct()
    left, right = rows.withColumnRenamed("g", "a"), rows.withColumnRenamed("g", "b")
    return left.join(right, "i").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def depends_on(imports: DataFrame, exports: DataFrame) -> DataFrame:
    """``src, dst, n``: repositories and the others whose exports they import. Both inputs: ``repo, name``."""
    i = imports.select(F.col("repo").alias("src"), "name").distinct()
    e = exports.select(F.col("repo").alias("dst"), "name").distinct()
    return i.join(e, "name").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def unique_names(rows: DataFrame, name: str, target: str) -> DataFrame:
    """Names with exactly one target: ``name, target``."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.min(target).alias("target"), F.max(target).alias("_m")).where("target = _m").drop("_m")


def resolve_names(entities: DataFrame) -> DataFrame:
    """``name, entity_id``: the last entity of each name by ``ordinal``."""
    return entities.groupBy("name").agg(F.max_by("entity_id", "ordinal").alias("entity_id"))


def build_edges(entities: DataFrame) -> DataFrame:
    """``src, dst, relationship, seq`` of ``entities`` (``entity_id, name, type, file_path, bases, methods, imports, refs, ordinal``).

    A file contains the other entities of its path; a class inherits from its bases and contains its methods (by file, class and
    method, else by name); functions and methods call what they import by name and reference what they mention. Unknown names and
    links to oneself give no edge.
    """
    index = resolve_names(entities).withColumnRenamed("entity_id", "to")
    files = entities.where("type = 'file'").select(F.col("entity_id").alias("src"), "file_path", "ordinal")
    inside = entities.where("type <> 'file'").select(F.col("entity_id").alias("dst"), "file_path")
    contains = files.join(inside, "file_path").select("src", "dst", F.lit("contains").alias("relationship"), (F.col("ordinal") * 4).alias("seq"))

    def named(kinds: list[str], column: str, relationship: str, step: int) -> DataFrame:
        rows = entities.where(F.col("type").isin(kinds)).select(F.col("entity_id").alias("src"), F.explode(column).alias("name"), "ordinal")
        return rows.join(index, "name").where("src <> to").select("src", F.col("to").alias("dst"), F.lit(relationship).alias("relationship"), (F.col("ordinal") * 4 + step).alias("seq"))

    methods = entities.where("type = 'method'").select(F.col("entity_id").alias("dst"), F.col("file_path").alias("_f"), F.col("class").alias("_c"))
    classes = entities.where("type = 'class'").select(F.col("entity_id").alias("src"), F.col("file_path").alias("_f"), F.col("name").alias("_c"), "ordinal")
    own = classes.join(methods, ["_f", "_c"]).select("src", "dst", F.lit("contains").alias("relationship"), (F.col("ordinal") * 4 + 2).alias("seq"))
    parts = [contains, named(["class"], "bases", "inherits", 1), own, named(["function", "method"], "refs", "references", 2), named(["function", "method"], "imports", "calls", 3)]
    return reduce(DataFrame.unionByName, parts).distinct()


def by_package(nodes: DataFrame) -> DataFrame:
    """``package, type, n, first``: nodes counted by the folder of their file, with the least id of each kind."""
    package = F.coalesce(F.nullif(F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))
    return nodes.groupBy(package.alias("package"), "type").agg(F.count("*").alias("n"), F.min("entity_id").alias("first"))


def mermaid(edges: DataFrame, focus: str | None = None, most: int = 40) -> str:
    """A Mermaid flowchart: the focus with three neighbours of each relation, or the ``most`` nodes of highest degree. The driver gets
    that bounded part alone."""
    if focus:
        order = Window.partitionBy("relationship").orderBy("other")
        near = incident(edges).where((F.col("node") == focus) & (F.col("relationship") != "references")).withColumn("_n", F.row_number().over(order)).where("_n <= 3")
        rows = [(r["other"], focus, r["relationship"]) if r["incoming"] else (focus, r["other"], r["relationship"]) for r in near.orderBy("relationship", "other").limit(most).collect()]
    else:
        top = top_degree(edges, most).select("node")
        kept = edges.join(top, edges["src"] == top["node"], "left_semi").join(top, edges["dst"] == top["node"], "left_semi")
        rows = [(r["src"], r["dst"], r["relationship"]) for r in kept.orderBy("src", "dst", "relationship").limit(most * 4).collect()]
    names = {n: f"n{i}" for i, n in enumerate(dict.fromkeys(x for r in rows for x in r[:2]))}
    return "\n".join(["flowchart LR", *[f'  {i}["{n}"]' for n, i in names.items()], *[f"  {names[a]} -->|{r}| {names[b]}" for a, b, r in rows]])
