"""The file and symbol graph: nodes, edges, PageRank, communities and what is read off them.

Iterative operators keep two small tables (state and edges) and cut their lineage with a
written table every round, so a lost executor costs one round at most. Convergence is read
from one aggregated row; neither nodes nor edges ever come to the driver.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import prefix
from ..schemas import Params
from ..storage import cut, forget
from .ranks import running_totals, top_by
from .rules import marker


def build_nodes(files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One node a key: files by path, symbols by ``path:name``; the first of equal keys stays (files first, input order)."""
    f = files.where("coalesce(is_file, true)").select(
        "repo_id", F.col("path").alias("key"), F.lit("file").alias("node_type"), F.col("path").alias("name"), F.lit("file").alias("type"), "path", F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("line")
    )
    rows = f
    if symbols is not None:
        s = symbols.select(
            "repo_id", F.concat_ws(":", "file_path", "name").alias("key"), F.lit("symbol").alias("node_type"), "name", "type", F.col("file_path").alias("path"), F.lit(1).alias("kind"), "seq", F.coalesce("line", F.lit(0)).alias("line")
        )
        rows = f.unionByName(s)
    value = F.struct("node_type", "name", "type", "path", "line")
    first = rows.groupBy("repo_id", "key").agg(F.min_by(value, F.struct("kind", "seq", "line")).alias("v"))
    return first.select("repo_id", "key", "v.*")


def contains_edges(nodes: DataFrame) -> DataFrame:
    """file -> symbol for each kept symbol whose file is a node."""
    files = nodes.where("node_type = 'file'").select("repo_id", "path")
    s = nodes.where("node_type = 'symbol'").join(files, ["repo_id", "path"], "left_semi")
    return s.select("repo_id", F.col("path").alias("src"), F.col("key").alias("dst"), F.lit("contains").alias("rel"))


def _both_ends(edges: DataFrame, nodes: DataFrame, how: str) -> DataFrame:
    keys = nodes.select("repo_id", "key")
    semi = edges.join(keys.withColumnRenamed("key", "src"), ["repo_id", "src"], "left_semi").join(keys.withColumnRenamed("key", "dst"), ["repo_id", "dst"], "left_semi")
    return semi if how == "semi" else edges.join(semi.select("repo_id", "src", "dst").distinct(), ["repo_id", "src", "dst"], "left_anti")


def add_relations(edges: DataFrame, nodes: DataFrame, order: str | None = None) -> DataFrame:
    """Edges whose ends are both nodes; of several between one ordered pair the last (by ``order``) stays."""
    kept = _both_ends(edges, nodes, "semi")
    rank = F.col(order) if order else F.lit(0)
    return kept.groupBy("repo_id", "src", "dst").agg(F.max_by("rel", F.struct(rank, "rel")).alias("rel"))


def add_call_edges(calls: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, errors): calls between symbols that are nodes, and the rows with an unknown end."""
    symbols = nodes.where("node_type = 'symbol'")
    calls = calls.select("repo_id", "src", "dst", F.lit("calls").alias("rel"))
    return _both_ends(calls, symbols, "semi").distinct(), _both_ends(calls, symbols, "anti").distinct()


def add_co_change_edges(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both directions of each pair (a, b) of files that are nodes."""
    e = pairs.select("repo_id", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select("repo_id", F.col("b").alias("src"), F.col("a").alias("dst")))
    return _both_ends(e.withColumn("rel", F.lit("co-change")), nodes.where("node_type = 'file'"), "semi").distinct()


#: Edges of one end that one task joins, about: a hub's edges are cut into parts of this many.
HUB = 100_000


def cut_by_degree(edges: DataFrame, end: str, other: str, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """(edges with ``part``, (repo_id, key, degree, parts)): a vertex cut at ``end``.

    An end with more than ``hub`` edges gets several parts, dealt by the other end; ``in_parts`` copies its row to each of them.
    """
    sizes = edges.groupBy("repo_id", F.col(end).alias("key")).agg(F.count("*").alias("degree")).withColumn("parts", F.ceil(F.col("degree") / hub).cast("int"))
    hubs = sizes.where("parts > 1").select("repo_id", F.col("key").alias(end), "parts")
    rows = edges.join(hubs, ["repo_id", end], "left")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64(other), F.col("parts")).cast("int")).otherwise(0)
    return rows.withColumn("part", part).drop("parts"), sizes


def in_parts(rows: DataFrame, parts: str = "parts") -> DataFrame:
    """A row for each part of its vertex."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)


def pagerank(nodes: DataFrame, edges: DataFrame, p: Params = Params(), max_iter: int = 100, tolerance: float = 1e-6, hub: int = HUB) -> DataFrame:
    """(repo_id, key, pagerank): unweighted over all edge types; ranks of a repository sum to 1.

    The mass of nodes without out-edges is spread evenly. Stops when the 2-norm of the change is
    below ``tolerance`` in every repository, or after ``max_iter`` rounds (0 tolerance: exactly that many).
    The edges of a hub lie in parts, each with a copy of its rank; what flows into a node is summed by task first.
    """
    d = p.damping
    links, degree = cut_by_degree(edges.select("repo_id", "src", "dst").distinct(), "src", "dst", hub)
    links = _dealt(cut(links, "pr_links"), "repo_id", "src", "part")
    sizes = nodes.groupBy("repo_id").agg(F.count("*").alias("n"))
    state = nodes.select("repo_id", "key").distinct().join(sizes, "repo_id").join(degree.withColumnRenamed("degree", "out"), ["repo_id", "key"], "left")
    state = cut(state.select("repo_id", "key", "n", "out", "parts", (1 / F.col("n")).alias("r")), "pr_state")
    for _ in range(max_iter):
        sent = in_parts(state.where("out is not null").select("repo_id", F.col("key").alias("src"), (F.col("r") / F.col("out")).alias("share"), "parts"))
        inflow = links.join(sent, ["repo_id", "src", "part"]).groupBy("repo_id", F.col("dst").alias("key")).agg(F.sum("share").alias("flow"))
        lost = state.groupBy("repo_id").agg(F.sum(F.when(F.col("out").isNull(), F.col("r")).otherwise(0.0)).alias("lost"))
        new = state.join(inflow, ["repo_id", "key"], "left").join(lost, "repo_id")
        value = (1 - d) / F.col("n") + d * (F.coalesce("flow", F.lit(0.0)) + F.col("lost") / F.col("n"))
        # a round reads the state three times, so each round's state is written once
        new = cut(new.select("repo_id", "key", "n", "out", "parts", value.alias("r"), F.col("r").alias("old")), "pr_state")
        before, state = state, new
        forget(before)
        if tolerance > 0:
            worst = new.groupBy("repo_id").agg(F.sqrt(F.sum((F.col("r") - F.col("old")) ** 2)).alias("c")).agg(F.max("c")).first()[0]
            if worst is None or worst < tolerance:
                break
    links.unpersist()
    return state.select("repo_id", "key", F.col("r").alias("pagerank"))


def _dealt(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges that every round joins by the same keys: dealt by them once and kept (spilled to disk if need be).

    A hub's edges have several keys, so no partition holds them all. What a lost executor held is read again
    from the written table below.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.repartition(n, *keys).persist()


def communities(nodes: DataFrame, edges: DataFrame, p: Params = Params(), max_rounds: int | None = None, hub: int = HUB) -> DataFrame:
    """(repo_id, key, community_id): modularity local moving, deterministic.

    Every round half of the nodes (by the first digit of the MD5 of key and round) may move to the neighbouring
    community with the best gain w(i,C) - r*k_i*S_C/2m, if it beats staying by more than 1e-9;
    ties go to the smallest community. Ids are numbered from 0 within a repository. Stops when both
    halves stay, at ``p.rounds`` rounds (each: both halves). A hub's edges lie in parts with a copy of its label, and its
    options are dealt by their communities.
    """
    pairs = edges.select("repo_id", "src", "dst").where("src <> dst").distinct()
    both = pairs.unionByName(pairs.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    w = cut(both.groupBy("repo_id", "src", "dst").agg(F.count("*").cast("double").alias("w")), "co_links")  # all below reads it
    w, sizes = cut_by_degree(w, "dst", "src", hub)
    near = _dealt(w, "repo_id", "dst", "part")
    degree = w.groupBy("repo_id", F.col("src").alias("key")).agg(F.sum("w").alias("k"))
    total = degree.groupBy("repo_id").agg(F.sum("k").alias("m2"))
    state = nodes.select("repo_id", "key").distinct().join(degree, ["repo_id", "key"], "left").join(total, "repo_id", "left").join(sizes.drop("degree"), ["repo_id", "key"], "left")
    state = cut(state.select("repo_id", "key", F.coalesce("k", F.lit(0.0)).alias("k"), F.coalesce("m2", F.lit(0.0)).alias("m2"), F.coalesce("parts", F.lit(1)).alias("parts"), F.col("key").alias("c")), "co_state")
    most = state.agg(F.max("parts")).first()[0] or 1
    still = 0
    for i in range(2 * (max_rounds or p.rounds)):
        size = state.groupBy("repo_id", "c").agg(F.sum("k").alias("s"))
        moves_now = lambda key: F.instr(F.lit("0123456789abcdef"), F.md5(F.concat(key, F.lit(f":{i // 2}"))).substr(1, 1)) % 2 == i % 2  # noqa: B023, E731
        turn = state.where(moves_now("key") & (F.col("k") > 0))
        label = in_parts(state.select("repo_id", F.col("key").alias("dst"), F.col("c").alias("to"), "parts"))
        into = near.where(moves_now("src")).join(label, ["repo_id", "dst", "part"]).select("repo_id", F.col("src").alias("key"), "to", "w")
        stay = turn.select("repo_id", "key", F.col("c").alias("to"), F.lit(0.0).alias("w"))
        options = into.unionByName(stay).groupBy("repo_id", "key", "to").agg(F.sum("w").alias("w"))
        options = _with_own(options, turn.select("repo_id", "key", "k", "m2", "c", "parts"), most).join(size.withColumnRenamed("c", "to"), ["repo_id", "to"])
        others = F.col("s") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        options = options.select("repo_id", "key", "to", "c", (F.col("w") - p.resolution * F.col("k") * others / F.col("m2")).alias("gain"))
        best = options.groupBy("repo_id", "key").agg(
            F.min_by("to", F.struct(-F.round("gain", 9), F.col("to"))).alias("to"), F.max("gain").alias("gain"), F.max(F.when(F.col("to") == F.col("c"), F.col("gain"))).alias("own")
        )
        moves = best.where(F.col("gain") > F.col("own") + 1e-9).select("repo_id", "key", "to")
        new = state.join(moves, ["repo_id", "key"], "left")
        new = cut(new.select("repo_id", "key", "k", "m2", "parts", F.coalesce("to", "c").alias("c"), F.col("to").isNotNull().alias("moved")), "co_state")
        before, state = state, new
        forget(before)
        moved = not new.where("moved").isEmpty()
        still = i % 2 * still + (not moved)
        if still == 2:
            break
    near.unpersist()
    names = state.select("repo_id", "c", F.lit(1).alias("one")).distinct()
    ids = running_totals(names, "repo_id", "c", "one").select("repo_id", "c", F.col("below").cast("bigint").alias("community_id"))
    return state.join(ids, ["repo_id", "c"]).select("repo_id", "key", "community_id")


def _with_own(options: DataFrame, own: DataFrame, most: int) -> DataFrame:
    """Options with their node's columns; where there are hubs, options are dealt by their communities too.

    The hubs' names are joined first (few rows), so that options of other nodes keep one part.
    """
    if most == 1:
        return options.join(own.drop("parts"), ["repo_id", "key"])
    hubs = own.where("parts > 1").select("repo_id", "key", "parts")
    options = options.join(hubs, ["repo_id", "key"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    return options.join(in_parts(own), ["repo_id", "key", "part"]).drop("part")


def community_count(labels: DataFrame) -> DataFrame:
    return labels.groupBy("repo_id").agg(F.count_distinct("community_id").alias("communities"))


def pagerank_threshold(nodes: DataFrame, top: float) -> DataFrame:
    """(repo_id, value): the PageRank at index int(n * (1 - top)) of the files in ascending order.

    Ranks are counted on distinct values, dealt by ranges, so no repository is ordered in one task.
    """
    counts = nodes.where("node_type = 'file'").groupBy("repo_id", "pagerank").agg(F.count("*").alias("c"))
    ranked = running_totals(counts, "repo_id", "pagerank", "c").select("repo_id", "pagerank", (F.col("below") + F.col("c")).alias("upto"), F.col("total").alias("n"))
    index = F.least(F.floor(F.col("n") * (1.0 - top)), F.col("n") - 1)
    return ranked.where(F.col("upto") > index).groupBy("repo_id").agg(F.min("pagerank").alias("value"))


def dead_code(nodes: DataFrame, edges: DataFrame, p: Params = Params()) -> DataFrame:
    """Symbols with a name and no incoming call."""
    called = edges.where("rel = 'calls'").select("repo_id", F.col("dst").alias("key")).distinct()
    rows = nodes.where("node_type = 'symbol' and name <> ''").join(called, ["repo_id", "key"], "left_anti")
    m = marker("dead_code", "low", F.format_string("Symbol '%s' has zero incoming call edges", "name"), F.col("line"), p.dead_code_deduction, "dead_code")
    return rows.select("repo_id", F.col("path").alias("file"), m.alias("m")).select("repo_id", "file", "m.*")


def phantom_coupling(files: DataFrame, nodes: DataFrame, edges: DataFrame, p: Params = Params()) -> DataFrame:
    """Files that change often under shared ownership and have no edge to another file."""
    keys = nodes.where("node_type = 'file'").select("repo_id", F.col("key").alias("path"))
    wanted = files.where("coalesce(is_file, true)").where((F.col("churn") >= p.phantom_churn) & (F.col("ownership") < p.phantom_ownership))
    ends = edges.join(keys.withColumnRenamed("path", "src"), ["repo_id", "src"], "left_semi").join(keys.withColumnRenamed("path", "dst"), ["repo_id", "dst"], "left_semi")
    linked = ends.select("repo_id", F.explode(F.array("src", "dst")).alias("path")).distinct()
    rows = wanted.join(keys, ["repo_id", "path"], "left_semi").join(linked, ["repo_id", "path"], "left_anti")
    say = F.format_string("Phantom coupling detected in %s: Churn=%d, Ownership=%d%%", F.col("path"), F.col("churn"), F.floor(F.col("ownership") * 100))
    return rows.select("repo_id", F.col("path").alias("file"), marker("phantom_coupling", "medium", say).alias("m")).select("repo_id", "file", "m.*")


def hallucination_bait(symbols: DataFrame) -> DataFrame:
    """The second and later symbols of one name in one file, in input order.

    The first of each name is a minimum per key; the others are what is left by comparing with
    it, so a name that fills a third of the table is not sorted in one task.
    """
    first = symbols.groupBy("repo_id", "file_path", "name").agg(F.min("seq").alias("first"))
    rows = symbols.join(first, ["repo_id", "file_path", "name"]).where("seq > first")
    m = marker("hallucination_bait", "medium", F.format_string("Overlapping symbol name '%s' in the same module/file", "name"), F.col("line"))
    return rows.select("repo_id", F.col("file_path").alias("file"), m.alias("m")).select("repo_id", "file", "m.*")


# ---- reading the graph -------------------------------------------------------------------------


def neighbors(edges: DataFrame, node: str | None = None) -> DataFrame:
    """(repo_id, key, other, direction): out-neighbours are imports; in-neighbours not already seen are importers."""
    out = edges.select("repo_id", F.col("src").alias("key"), F.col("dst").alias("other"), F.lit(0).alias("d"))
    into = edges.select("repo_id", F.col("dst").alias("key"), F.col("src").alias("other"), F.lit(1).alias("d"))
    rows = out.unionByName(into)
    if node is not None:
        rows = rows.where(F.col("key") == node)
    rows = rows.groupBy("repo_id", "key", "other").agg(F.min("d").alias("d"))
    return rows.select("repo_id", "key", "other", F.when(F.col("d") == 0, "import").otherwise("importer").alias("direction"))


def degrees(edges: DataFrame) -> DataFrame:
    """In-degree and out-degree as the neighbour list counts them."""
    return neighbors(edges).groupBy("repo_id", "key").agg(F.count_if(F.col("direction") == "importer").alias("in_degree"), F.count_if(F.col("direction") == "import").alias("out_degree"))


def percentile_of(rows: DataFrame, metric: str) -> DataFrame:
    """``rows`` with ``<metric>_percentile`` = round(100 * share of rows with a smaller value)."""
    counts = rows.groupBy("repo_id", metric).agg(F.count("*").alias("c"))
    ranked = running_totals(counts, "repo_id", metric, "c")
    table = ranked.select("repo_id", metric, F.floor(100 * F.col("below") / F.col("total") + 0.5).cast("int").alias(f"{metric}_percentile"))
    return rows.join(table, ["repo_id", metric])


def reach(edges: DataFrame, start: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(repo_id, key, depth): nodes within ``depth`` steps of the start nodes (repo_id, key).

    Frontier joins: each round joins only the newest nodes with the edges and drops what was seen.
    """
    e = edges.select("repo_id", "src", "dst")
    if not directed:
        e = e.unionByName(e.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    e = e.distinct()
    seen = cut(start.select("repo_id", "key").distinct().withColumn("depth", F.lit(0)), "reach")
    front = seen
    for d in range(1, depth + 1):
        new = front.select("repo_id", F.col("key").alias("src")).join(e, ["repo_id", "src"]).select("repo_id", F.col("dst").alias("key")).distinct()
        front = cut(new.join(seen, ["repo_id", "key"], "left_anti").withColumn("depth", F.lit(d)), "reach")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def ego_graph(edges: DataFrame, node: str, depth: int = 1) -> DataFrame:
    start = edges.select("repo_id", F.explode(F.array("src", "dst")).alias("key")).where(F.col("key") == node).distinct()
    return reach(edges, start, depth)


def shortest_path(edges: DataFrame, a: str, b: str, max_depth: int | None = None) -> DataFrame:
    """(repo_id, path, distance): one shortest directed path from a to b (the smallest by name), if any.

    Looks on until b is found or nothing new is reached; with ``max_depth`` longer paths aren't looked for.
    """
    e = edges.select("repo_id", "src", "dst").distinct()
    front = e.where(F.col("src") == a).select("repo_id").distinct().select("repo_id", F.lit(a).alias("key"), F.array(F.lit(a)).alias("path"))
    seen = front.select("repo_id", "key")
    for _ in count() if max_depth is None else range(max_depth):
        hit = front.where(F.col("key") == b)
        if front.isEmpty() or not hit.isEmpty():
            return hit.select("repo_id", "path", (F.size("path") - 1).alias("distance"))
        step = front.withColumnRenamed("key", "src").join(e, ["repo_id", "src"]).select("repo_id", F.col("dst").alias("key"), F.concat("path", F.array("dst")).alias("path"))
        step = step.join(seen, ["repo_id", "key"], "left_anti").groupBy("repo_id", "key").agg(F.min("path").alias("path"))
        front = cut(step, "path")
        seen = seen.unionByName(front.select("repo_id", "key"))
    return front.where(F.col("key") == b).select("repo_id", "path", (F.size("path") - 1).alias("distance"))


def classify_edges(links: DataFrame, labels: DataFrame, confident: float = 0.5) -> DataFrame:
    """``links(source, target, imported_names, confidence)`` with a class each."""
    a = labels.select("repo_id", F.col("key").alias("source"), F.col("community_id").alias("ca"))
    b = labels.select("repo_id", F.col("key").alias("target"), F.col("community_id").alias("cb"))
    kind = (
        F.when(F.coalesce(F.col("confidence"), F.lit(1.0)) < confident, "lowConfidence")
        .when(F.coalesce(F.size("imported_names"), F.lit(0)) <= 0, "dynamic")
        .when(F.col("ca") == F.col("cb"), "internal")
        .when(F.col("ca") != F.col("cb"), "crossCommunity")
        .otherwise("import")
    )
    return links.join(a, ["repo_id", "source"], "left").join(b, ["repo_id", "target"], "left").withColumn("edge_class", kind).drop("ca", "cb")


EDGE_CLASS_ORDER = ["internal", "import", "crossCommunity", "dynamic", "lowConfidence"]


def cap_edges_per_source(classified: DataFrame, most: int = 25, order: str = "target") -> DataFrame:
    """Distinct pairs, at most ``most`` a source, by class and then order (the cap is the feature: a drawing limit)."""
    rank = F.array_position(F.array(*map(F.lit, EDGE_CLASS_ORDER)), F.col("edge_class"))
    once = classified.groupBy("repo_id", "source", "target").agg(F.min(F.struct(rank.alias("rank"), "edge_class")).alias("e"))
    w = Window.partitionBy("repo_id", "source").orderBy("e.rank", order)
    return once.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("repo_id", "source", "target", "e.edge_class")


def dedupe_edges(links: DataFrame) -> DataFrame:
    """One edge a pair: all names, how many edges, the largest confidence."""
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("imported_names"))))
    return links.groupBy("repo_id", "source", "target").agg(names.alias("imported_names"), F.count("*").alias("edge_count"), F.max("confidence").alias("confidence"))


def group_files_as_modules(files: DataFrame, under: str = "") -> DataFrame:
    """Files by the next path segment below ``under``: file and symbol counts, mean PageRank, share with a page.

    A repository with more than half of its files below ``packages/`` takes two segments there.
    """
    base = under.rstrip("/") + "/" if under else ""
    rows = files.where(F.col("path").startswith(base)) if base else files
    rest = F.expr(f"substring(path, {len(base) + 1})")
    share = rows.groupBy("repo_id").agg(F.avg(F.col("path").startswith("packages/").cast("double")).alias("packages"))
    rows = rows.join(share, "repo_id")
    parts = F.split(rest, "/")
    mono = (F.col("packages") > 0.5) & parts[0].eqNullSafe("packages") & (F.size(parts) > 2)
    module = F.when(mono, prefix(rest, 2)).when(F.size(parts) > 1, parts[0]).otherwise("root")
    rows = rows.withColumn("module", F.concat(F.lit(base), module))
    return rows.groupBy("repo_id", "module").agg(
        F.count("*").alias("file_count"), F.sum("symbol_count").alias("symbol_count"), F.avg("pagerank").alias("avg_pagerank"), F.avg(F.col("has_doc").cast("double")).alias("doc_fraction")
    )


def module_edges(edges: DataFrame, module_of: DataFrame) -> DataFrame:
    """File edges between distinct modules, counted. ``module_of``: (repo_id, key, module)."""
    a = module_of.select("repo_id", F.col("key").alias("src"), F.col("module").alias("source"))
    b = module_of.select("repo_id", F.col("key").alias("dst"), F.col("module").alias("target"))
    rows = edges.join(a, ["repo_id", "src"]).join(b, ["repo_id", "dst"]).where("source <> target")
    return rows.groupBy("repo_id", "source", "target").agg(F.count("*").alias("edge_count"))


def module_dependency_matrix(links: DataFrame, modules: DataFrame, top: int = 15) -> DataFrame:
    """Edge counts between the top connected modules by mean PageRank (of all repositories, as each is a column), one column a target."""
    links = cut(links, "links")
    ends = links.select("repo_id", F.explode(F.array("source", "target")).alias("module")).distinct()
    best = modules.join(ends, ["repo_id", "module"], "left_semi").orderBy(F.desc("avg_pagerank"), "module").limit(top).select("repo_id", "module")
    rows = links.join(F.broadcast(best.withColumnRenamed("module", "source")), ["repo_id", "source"], "left_semi").join(F.broadcast(best.withColumnRenamed("module", "target")), ["repo_id", "target"], "left_semi")
    names = sorted({r.module for r in best.collect()})  # at most ``top``
    return rows.groupBy("repo_id", "source").pivot("target", names).sum("edge_count") if names else rows.select("repo_id", "source").distinct()


def module_dep_count(links: DataFrame) -> DataFrame:
    """The edges that touch a module as source or target."""
    ends = links.select("repo_id", F.explode(F.array("source", "target")).alias("module"), "edge_count")
    return ends.groupBy("repo_id", "module").agg(F.sum("edge_count").alias("dependencies"))


def module_community(modules: DataFrame, tops: DataFrame, palette: int = 24) -> DataFrame:
    """The community whose top file lies in the module (the smallest of several), else a hash of its name."""
    inside = modules.join(tops, (modules.repo_id == tops.repo_id) & (F.substring_index(tops.top_file, "/", 1) == F.substring_index(modules.module, "/", 1)) & tops.top_file.startswith(F.concat(modules.module, F.lit("/"))), "left").drop(tops.repo_id)
    return inside.groupBy("repo_id", "module").agg(F.coalesce(F.min("community_id"), F.pmod(F.crc32(F.first("module").cast("binary")), F.lit(palette))).alias("community_id"))


def centrality_leaderboard(metrics: DataFrame, metric: str = "pagerank", limit: int = 10) -> DataFrame:
    """Each repository's top nodes by pagerank, betweenness or degree (in + out)."""
    value = F.col("in_degree") + F.col("out_degree") if metric == "degree" else F.col(metric)
    return top_by(metrics.select("repo_id", "key", value.alias("value")), [F.desc("value"), "key"], limit)


def directory_descendants(files: DataFrame) -> DataFrame:
    """(repo_id, directory, path): every ancestor folder of every file."""
    parts = F.split("path", "/")
    steps = F.when(F.size(parts) > 1, F.sequence(F.lit(1), F.size(parts) - 1)).otherwise(F.array().cast("array<int>"))
    return files.select("repo_id", F.explode(F.transform(steps, lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("directory"), "path")


def flow_edges(traces: DataFrame) -> DataFrame:
    """(repo_id, src, dst): neighbours along each trace, both ways."""
    n = F.size("trace") - 1
    pairs = F.when(n > 0, F.arrays_zip(F.slice("trace", F.lit(1), n).alias("a"), F.slice("trace", F.lit(2), n).alias("b")))
    e = traces.select("repo_id", F.explode(pairs).alias("p")).select("repo_id", F.col("p.a").alias("src"), F.col("p.b").alias("dst"))
    return e.unionByName(e.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def start_here_files(nodes: DataFrame, docs: DataFrame, top: int = 5) -> DataFrame:
    """Per repository the top files by PageRank among entry points (all files when there are none), with their page."""
    files = nodes.where("node_type = 'file'")
    any_entry = files.groupBy("repo_id").agg(F.max("is_entry_point").alias("any"))
    rows = files.join(any_entry, "repo_id").where("is_entry_point or not any")
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("pagerank"), "path"))).where(F.col("k") <= top)
    return rows.select("repo_id", "path", "pagerank", "k").join(docs.select("repo_id", F.col("target_path").alias("path"), "page_id"), ["repo_id", "path"], "left")


def docs_index(pages: DataFrame) -> DataFrame:
    """(repo_id, target_path, page_id): module pages before file pages, later before earlier."""
    usable = pages.where(F.col("page_type").isin("module_page", "file_page"))
    return usable.groupBy("repo_id", "target_path").agg(F.max_by("page_id", F.struct(F.col("page_type") == "module_page", "seq")).alias("page_id"))


def node_search(nodes: DataFrame, q: str, limit: int = 20, slips: int = 3) -> DataFrame:
    """Each repository's best matches: exact, prefix, contained, then mistyped, each by edit distance; an empty query gives the top by PageRank.

    Mistyped: a part of the key between slashes, dots and colons lies within one edit in ``slips`` characters of the query. Two
    strings within k edits share all but 2k of their pairs of neighbouring letters, so only parts that share enough
    of them are compared letter by letter.
    """
    if not q:
        return top_by(nodes, [F.desc("pagerank"), "key"], limit)
    q, k = q.lower(), F.lower("key")
    edits = len(q) // slips
    pairs = F.array(*[F.lit(p) for p in sorted({q[i : i + 2] for i in range(len(q) - 1)})]) if len(q) > 1 else F.array().cast("array<string>")
    least = len({q[i : i + 2] for i in range(len(q) - 1)}) - 2 * edits
    own = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.length(x) - 1, F.lit(1))), lambda i: F.substr(x, i, F.lit(2)))
    near = lambda x: (F.abs(F.length(x) - len(q)) <= edits) & (F.size(F.array_intersect(own(x), pairs)) >= least)
    distance = F.array_min(F.transform(F.filter(F.split(k, "[/.:]"), near), lambda x: F.levenshtein(x, F.lit(q))))
    rows = nodes.withColumn("slips_", F.when(~k.contains(q), F.coalesce(distance, F.lit(1 << 30))))
    rank = F.when(k == q, 0).when(k.startswith(q), 1).when(k.contains(q), 2).otherwise(3)
    rows = rows.where(k.contains(q) | (F.col("slips_") <= edits))
    return top_by(rows, [rank, F.coalesce("slips_", F.levenshtein(k, F.lit(q))), "key"], limit).drop("slips_")


def hide_tests(nodes: DataFrame) -> DataFrame:
    from ..functions.paths import is_test_filename

    return nodes.where(~is_test_filename("path"))


def community_visibility(nodes: DataFrame, shown: list[int]) -> DataFrame:
    return nodes.where(F.col("community_id").isin(*shown))


def communities_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per community: members, top file, cohesion = internal / (internal + cross) edges."""
    label = nodes.select("repo_id", "key", "community_id")
    e = edges.join(label.select("repo_id", F.col("key").alias("src"), F.col("community_id").alias("ca")), ["repo_id", "src"]).join(label.select("repo_id", F.col("key").alias("dst"), F.col("community_id").alias("cb")), ["repo_id", "dst"])
    per = e.select("repo_id", F.explode(F.array_distinct(F.array("ca", "cb"))).alias("community_id"), (F.col("ca") == F.col("cb")).alias("inner"))
    per = per.groupBy("repo_id", "community_id").agg(F.count_if("inner").alias("internal"), F.count_if(~F.col("inner")).alias("cross"))
    own = nodes.groupBy("repo_id", "community_id").agg(F.count("*").alias("members"), F.max_by("path", F.struct("pagerank", "path")).alias("top_file"))
    out = own.join(per, ["repo_id", "community_id"], "left").fillna({"internal": 0, "cross": 0})
    return out.withColumn("cohesion", F.coalesce(F.try_divide(F.col("internal"), F.col("internal") + F.col("cross")), F.lit(0.0)))


def community_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Cross edges between communities, counted: neighbours of a community and the architecture graph."""
    label = nodes.select("repo_id", "key", F.col("community_id").alias("module"))
    return module_edges(edges, label)


def graph_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees, PageRank percentile and community of every node."""
    rows = percentile_of(nodes.select("repo_id", "key", "pagerank", "community_id"), "pagerank")
    return rows.join(degrees(edges), ["repo_id", "key"], "left").fillna({"in_degree": 0, "out_degree": 0})


def betweenness(nodes: DataFrame, edges: DataFrame, sources: int | None = 16, error: float | None = None, doubt: float = 0.1) -> DataFrame:
    """Betweenness over directed shortest paths of any length; exact with ``sources=None``.

    Else an estimate from source nodes drawn in each repository (the smallest hashes of repository and key), scaled by the
    repository's nodes over its sources; a repository with fewer nodes is exact. With ``error`` each repository of n nodes gets
    ln(2n / doubt) / (2 error^2) sources: by Hoeffding's bound no node is off by more than error * n * (n - 2), but with
    probability ``doubt``. Breadth-first counts of shortest paths forwards until nothing new is
    reached, then dependencies backwards, all sources at once.
    """
    e = edges.select("repo_id", "src", "dst").distinct()
    roots = all_ = nodes.select("repo_id", "key").distinct()
    if error is not None or sources is not None:
        n = all_.groupBy("repo_id").agg(F.count("*").alias("n"))
        wanted = F.ceil(F.log(2 * F.col("n") / doubt) / (2 * error**2)) if error is not None else F.lit(sources)
        # hashes are uniform, so a cut by them leaves few more rows than wanted before the exact rank
        drawn = all_.join(n.withColumn("wanted", wanted), "repo_id").withColumn("order", F.pmod(F.xxhash64("repo_id", "key"), F.lit(1 << 40)))
        drawn = drawn.where((F.col("wanted") * 3 + 50 >= F.col("n")) | (F.col("order") / float(1 << 40) * F.col("n") <= 2 * F.col("wanted") + 50))
        place = F.row_number().over(Window.partitionBy("repo_id").orderBy("order", "key"))
        roots = cut(drawn.withColumn("place", place).where(F.col("place") <= F.col("wanted")).select("repo_id", "key"), "bc_roots")
    seen = cut(roots.select("repo_id", F.col("key").alias("s"), "key", F.lit(0).alias("d"), F.lit(1.0).alias("sigma")), "bc")
    front, depth = seen, 0
    for d in count(1):
        step = front.withColumnRenamed("key", "src").join(e, ["repo_id", "src"]).groupBy("repo_id", "s", F.col("dst").alias("key")).agg(F.sum("sigma").alias("sigma"))
        front = cut(step.join(seen, ["repo_id", "s", "key"], "left_anti").select("repo_id", "s", "key", F.lit(d).alias("d"), "sigma"), "bc")
        if front.isEmpty():
            break
        seen, depth = seen.unionByName(front), d
    score = seen.select("repo_id", "s", "key", F.lit(0.0).alias("dep"))
    for d in range(depth, 0, -1):
        child = seen.where(F.col("d") == d).join(score, ["repo_id", "s", "key"]).select("repo_id", "s", F.col("key").alias("dst"), "sigma", "dep")
        parent = seen.where(F.col("d") == d - 1).select("repo_id", "s", F.col("key").alias("src"), F.col("sigma").alias("up"))
        flow = child.join(e, ["repo_id", "dst"]).join(parent, ["repo_id", "s", "src"]).groupBy("repo_id", "s", F.col("src").alias("key")).agg(F.sum(F.col("up") / F.col("sigma") * (1 + F.col("dep"))).alias("add"))
        score = cut(score.join(flow, ["repo_id", "s", "key"], "left").select("repo_id", "s", "key", (F.col("dep") + F.coalesce("add", F.lit(0.0))).alias("dep")), "bc")
    scale = all_.groupBy("repo_id").agg(F.count("*").alias("all")).join(roots.groupBy("repo_id").agg(F.count("*").alias("used")), "repo_id")
    out = score.where("key <> s").groupBy("repo_id", "key").agg(F.sum("dep").alias("b")).join(scale, "repo_id")
    out = out.select("repo_id", "key", (F.col("b") * F.col("all") / F.col("used")).alias("betweenness"))
    return nodes.select("repo_id", "key").join(out, ["repo_id", "key"], "left").fillna({"betweenness": 0.0})


def callers_callees(edges: DataFrame, limit: int = 50) -> DataFrame:
    """Per symbol: callers and callees, counted, each list cut at ``limit`` (the lists' feature)."""
    calls = edges.where("rel = 'calls'").select("repo_id", "src", "dst").distinct()
    rows = calls.select("repo_id", F.col("dst").alias("key"), F.col("src").alias("other"), F.lit("caller").alias("side")).unionByName(calls.select("repo_id", F.col("src").alias("key"), F.col("dst").alias("other"), F.lit("callee").alias("side")))
    total = rows.groupBy("repo_id", "key", "side").agg(F.count("*").alias("total"))
    # the limit on ranks is pushed below the shuffle, so a hub's task gets `limit` rows from each task before it
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo_id", "key", "side").orderBy("other"))).where(F.col("k") <= limit)
    per = ranked.groupBy("repo_id", "key", "side").agg(F.array_sort(F.collect_list("other")).alias("others"))
    return total.join(per, ["repo_id", "key", "side"]).withColumn("truncated", F.col("total") > limit)


def entry_points(edges: DataFrame) -> DataFrame:
    """Symbols that call and are not called."""
    calls = edges.where("rel = 'calls'")
    return calls.select("repo_id", F.col("src").alias("key")).distinct().join(calls.select("repo_id", F.col("dst").alias("key")).distinct(), ["repo_id", "key"], "left_anti")


def execution_flows(nodes: DataFrame, edges: DataFrame, top: int = 10, max_depth: int = 8) -> DataFrame:
    """(repo_id, entry, trace, communities): from the top entry points, step by step to the callee with the highest PageRank."""
    calls = edges.where("rel = 'calls'").select("repo_id", "src", "dst").distinct()
    rank = nodes.select("repo_id", "key", "pagerank", "community_id")
    entry = entry_points(edges).join(rank, ["repo_id", "key"]).orderBy(F.desc("pagerank"), "key").limit(top)
    flows = entry.select("repo_id", F.col("key").alias("entry"), F.col("key").alias("at"), F.array("key").alias("trace"), F.array("community_id").alias("communities"))
    best = calls.join(rank.withColumnRenamed("key", "dst"), ["repo_id", "dst"])
    for _ in range(max_depth - 1):
        step = flows.join(best.withColumnRenamed("src", "at"), ["repo_id", "at"], "left").withColumn("new", F.col("dst").isNotNull() & ~F.array_contains("trace", F.coalesce("dst", F.lit(""))))
        pick = F.max_by(F.struct("dst", "community_id"), F.struct(F.when(F.col("new"), F.col("pagerank")), F.col("dst")))
        step = step.groupBy("repo_id", "entry", "at", "trace", "communities").agg(pick.alias("p"), F.max("new").alias("any"))
        flows = cut(
            step.select(
                "repo_id", "entry", F.when(F.col("any"), F.col("p.dst")).alias("at"),
                F.when(F.col("any"), F.concat("trace", F.array("p.dst"))).otherwise(F.col("trace")).alias("trace"),
                F.when(F.col("any"), F.array_union("communities", F.array("p.community_id"))).otherwise(F.col("communities")).alias("communities"),
            ),
            "flows",
        )
    return flows.select("repo_id", "entry", "trace", "communities")


def hot_files(last_commits: DataFrame, edges: DataFrame, p: Params = Params(), days: int = 30, limit: int = 50) -> DataFrame:
    """The edges between the ``limit`` files of each repository (repo_id, path, commits, last) that changed most in the last ``days`` days."""
    recent = last_commits.where(F.col("last") > F.lit(p.as_of).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
    rank = F.row_number().over(Window.partitionBy("repo_id").orderBy(F.desc("commits"), "path"))
    keys = recent.withColumn("k", rank).where(F.col("k") <= limit).select("repo_id", F.col("path").alias("key"))
    return sub_graph(edges, keys)


def sub_graph(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The edges between the given nodes (repo_id, key)."""
    return edges.join(keys.withColumnRenamed("key", "src"), ["repo_id", "src"], "left_semi").join(keys.withColumnRenamed("key", "dst"), ["repo_id", "dst"], "left_semi")


def blast_radius(changed: DataFrame, edges: DataFrame, max_depth: int = 3) -> DataFrame:
    """(repo_id, key, depth): what depends on the changed nodes, by reversed edges."""
    back = edges.select("repo_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, changed, max_depth, directed=True)


def blast_score(changed: DataFrame, reached: DataFrame, hotspots: DataFrame, ranks: DataFrame) -> DataFrame:
    """Direct risk of each changed file, mean of hotspot and centrality percentile (0-1), and the repository's overall 0-10."""
    direct = changed.join(hotspots.select("repo_id", F.col("path").alias("key"), "churn_percentile"), ["repo_id", "key"], "left").join(ranks.select("repo_id", "key", "pagerank_percentile"), ["repo_id", "key"], "left").fillna(0)
    direct = direct.withColumn("risk", (F.col("churn_percentile") + F.col("pagerank_percentile")) / 200)
    wide = reached.where("depth > 0").groupBy("repo_id").agg(F.count("*").alias("transitive"))
    per = direct.groupBy("repo_id").agg(F.avg("risk").alias("direct_risk"), F.count("*").alias("changed"))
    out = per.join(wide, "repo_id", "left").fillna({"transitive": 0})
    return out.withColumn("overall", F.least(F.lit(10.0), 7 * F.col("direct_risk") + F.least(F.lit(3.0), F.log1p("transitive") / 2)))
