"""Dependency graphs: nodes, degrees, reachability, cycles, components and depth.

Loops cut their lineage in the shared folder. Reachability, whose result can be the square of the graph, is computed only if :func:`admission` finds
nodes and work within bounds; without it transitive degrees are null, and strong components are found by colours instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import ratio
from tessera.plans.checkpoints import cut_balanced, parts

#: Bounds of one machine, and those of a cluster, which the queries use.
NODE_LIMIT, WORK_LIMIT = 10_000, 100_000_000
CLUSTER_NODES, CLUSTER_WORK = 10**9, 10**18


def grouped_edges(declared: DataFrame) -> DataFrame:
    """Declared (source, target, class, line) as edges with their sorted, distinct evidence."""
    return declared.groupBy("source", "target", "class").agg(F.array_sort(F.collect_set("line")).alias("evidence"))


#: Kinds of nodes in the order in which one is taken: of a file, of what files declare.
KINDS = ("analyzed-file", "analyzed-file", "external-specifier", "unresolved-specifier")


def sized(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """Rows of equal ``by`` in one partition; as many partitions as ``rows`` need."""
    return df.repartition(parts(df.sparkSession, rows), *by)


def nodes(files: DataFrame, declared: DataFrame, rows: int) -> DataFrame:
    """Every file and every edge target with its kind (a file stays one), fan-in and fan-out over all edges, and internal degrees of files. Edges may be declared any
    number of times; ``rows`` tells about how many ends there are. The ends of a node meet in one partition; all counts are taken there from its distinct neighbours."""
    internal = F.col("class") == "internal"
    rank = F.when(internal, 1).when(F.col("class") == "external", 2).otherwise(3)
    d = declared.groupBy("source", "target").agg(F.bool_or(internal).alias("internal"), F.min(rank).alias("rank"))
    none, way = F.lit(None), lambda w: F.lit(w).alias("way")
    ends = d.select(F.col("source").alias("id"), F.col("target").alias("other"), way(True), "internal", none.cast("int").alias("rank")).union(d.select("target", "source", way(False), "internal", "rank"))
    kind = dict(files.dtypes)["id"]
    ends_and_files = ends.union(files.select("id", none.cast(kind), none.cast("boolean"), none.cast("boolean"), F.lit(0)))
    each = sized(ends_and_files, rows, "id").groupBy("id", "other", "way").agg(F.bool_or("internal").alias("internal"), F.min("rank").alias("rank"))
    count = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    into, out, i = ~F.col("way"), F.col("way"), F.col("internal")
    g = each.groupBy("id").agg(F.min("rank").alias("rank"), count(into, "fan_in"), count(out, "fan_out"), count(into & i, "di"), count(out & i, "do")).where("rank is not null")
    file = F.col("rank") <= 1
    return g.select("id", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1).alias("kind"), "fan_in", "fan_out", F.when(file, F.col("di")).alias("direct_in"), F.when(file, F.col("do")).alias("direct_out"))


def adjacency(edges: DataFrame) -> DataFrame:
    """Distinct internal (src, dst)."""
    return edges.where("class = 'internal'").select(F.col("source").alias("src"), F.col("target").alias("dst")).distinct()


def closure(adj: DataFrame) -> DataFrame:
    """All (src, dst) with a path of one edge or more, by squaring: the rounds are the logarithm of the longest shortest path."""
    seen = cut_balanced(adj)
    size = seen.count()
    while True:
        step = sized(seen, size, "dst").alias("f").join(sized(seen, size, "src").alias("e"), F.col("f.dst") == F.col("e.src")).select(F.col("f.src").alias("src"), F.col("e.dst").alias("dst"))
        seen = cut_balanced(sized(seen.union(step), 2 * size, "src", "dst").distinct())
        before, size = size, seen.count()
        if size == before:
            return seen


def admission(files: DataFrame, adj: DataFrame, node_limit: int = CLUSTER_NODES, work_limit: int = CLUSTER_WORK) -> tuple[str, int, int]:
    """Status (computed, not_applicable, size_limit, work_limit), nodes, and the bound n * (1 + edges) on the work."""
    n, e = files.count(), adj.count()
    work = n * (1 + e)
    return ("not_applicable" if not n else "size_limit" if n > node_limit else "work_limit" if work > work_limit else "computed"), n, work


def reachability(files: DataFrame, reach: DataFrame | None) -> DataFrame:
    """Transitive in and out degrees of every file, without itself; null if reachability was not admitted."""
    if reach is None:
        unknown = F.lit(None).cast("long")
        return files.select("id", unknown.alias("transitive_in"), unknown.alias("transitive_out"))
    r, n = reach.where("src != dst"), max(files.count(), reach.count())
    out = sized(r, n, "src").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("o"))
    into = sized(r, n, "dst").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("i"))
    zero = F.lit(0).cast("long")
    return sized(files, n, "id").join(out, "id", "left").join(into, "id", "left").select("id", F.coalesce("i", zero).alias("transitive_in"), F.coalesce("o", zero).alias("transitive_out"))


def strong_components(files: DataFrame, adj: DataFrame, reach: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id of those that reach each other; single files are their own. By the closure if there is one, else by colours."""
    if reach is None:
        return coloured_components(files, adj)
    n = reach.count()
    mutual = sized(reach, n, "src").alias("a").join(sized(reach, n, "dst").alias("b"), (F.col("a.src") == F.col("b.dst")) & (F.col("a.dst") == F.col("b.src"))).select(F.col("a.src").alias("id"), F.col("a.dst").alias("other"))
    least = mutual.groupBy("id").agg(F.min("other").alias("m"))
    return sized(files, max(n, files.count()), "id").join(least, "id", "left").select("id", F.least("id", F.coalesce("m", "id")).alias("component"))


def spread(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): the least ``colour`` of ``vertices`` (id, colour) that reaches each vertex along ``edges`` (src, dst), its own included; null ones do not spread."""
    now, n = cut_balanced(vertices), edges.count()
    m = max(n, now.count())
    while True:
        come = sized(sized(edges, m, "src").join(sized(now, m, "id"), F.col("src") == F.col("id")), n, "dst").groupBy("dst").agg(F.min("colour").alias("m"))
        after = cut_balanced(now.join(come, F.col("id") == F.col("dst"), "left").select("id", F.least("colour", "m").alias("next"), "colour"))
        done = after.where("not (next <=> colour)").isEmpty()
        now = after.select("id", F.col("next").alias("colour"))
        if done:
            return now


def coloured_components(files: DataFrame, adj: DataFrame) -> DataFrame:
    """As :func:`strong_components`, without the closure. Vertices with no edge in or none out are single. Of the rest, each takes the least id that reaches it as its
    colour; within a colour, those that reach that id back are its component. The rest goes round again."""
    edges, found = cut_balanced(adj.where("src != dst")), []
    while not edges.isEmpty():
        size = edges.count()
        while True:  # trim
            outs, ins = edges.select(F.col("src").alias("__o")).distinct(), edges.select(F.col("dst").alias("__i")).distinct()
            edges = cut_balanced(edges.join(outs, F.col("dst") == F.col("__o"), "left_semi").join(ins, F.col("src") == F.col("__i"), "left_semi"))
            before, size = size, edges.count()
            if size == before:
                break
        if not size:
            break
        vertices = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        colour = spread(vertices.select("id", F.col("id").alias("colour")), edges)
        a, b = (colour.select(F.col("id").alias(f"__{s}"), F.col("colour").alias(f"c{s}")) for s in "ab")
        inside = cut_balanced(edges.join(a, F.col("src") == F.col("__a")).join(b, F.col("dst") == F.col("__b")).where("ca = cb").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        back = spread(colour.select("id", F.when(F.col("id") == F.col("colour"), F.col("colour")).alias("colour")), inside).where("colour is not null")
        found.append(cut_balanced(back.select(F.col("id").alias("__f"), F.col("colour").alias("component"))))
        gone = found[-1].select(F.col("__f").alias("__g"))
        edges = cut_balanced(edges.join(gone, F.col("src") == F.col("__g"), "left_anti").join(gone, F.col("dst") == F.col("__g"), "left_anti"))
    every = reduce(DataFrame.union, found) if found else None
    return files.select("id", F.col("id").alias("component")) if every is None else files.join(every, F.col("id") == F.col("__f"), "left").select("id", F.coalesce("component", "id").alias("component"))


def cycles(scc: DataFrame, adj: DataFrame) -> DataFrame:
    """Components of more than one file, and files that depend on themselves: component, members, size."""
    loops = adj.where("src = dst").select(F.col("src").alias("id"), F.lit(True).alias("loop"))
    c = scc.join(loops, "id", "left").groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members"), F.count(F.lit(1)).alias("size"), F.bool_or(F.coalesce("loop", F.lit(False))).alias("loop"))
    return c.where("size > 1 or loop").select("component", "members", "size")


def weak_components(vertices: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, component) over all edges, whatever their direction: least ids spread until nothing changes."""
    labels = cut_balanced(vertices.select("id", F.col("id").alias("component")))
    n = pairs.count()
    both = cut_balanced(sized(pairs.select("src", "dst").union(pairs.select("dst", "src")).where("src != dst"), 2 * n, "src", "dst").distinct())
    m = max(2 * n, labels.count())
    while True:
        here = sized(labels, m, "id")
        near = sized(sized(both, m, "dst").join(here, F.col("dst") == F.col("id")).select("src", F.col("component").alias("c")), m, "src").groupBy("src").agg(F.min("c").alias("m"))
        after = cut_balanced(here.join(near, F.col("id") == F.col("src"), "left").select("id", F.least("component", F.coalesce("m", "component")).alias("next"), "component"))
        changed = after.where("next != component").isEmpty()
        labels = after.select("id", F.col("next").alias("component"))
        if changed:
            return labels
        # jump: a label's own label, which halves the rounds that long chains need
        other = labels.select(F.col("id").alias("__i"), F.col("component").alias("__c"))
        labels = cut_balanced(sized(labels, m, "component").join(sized(other, m, "__i"), F.col("component") == F.col("__i"), "left").select("id", F.least("component", F.coalesce("__c", "component")).alias("component")))


def condensation_depth(scc: DataFrame, adj: DataFrame) -> DataFrame:
    """(component, depth): edges on the longest path to each component of the condensed graph. Each round takes one more edge from the ends of the walks of the last, so
    only components that a walk of so many edges reaches are touched again."""
    scc, n = cut_balanced(scc), adj.count()
    m = max(n, scc.count())
    named = scc.select(F.col("id").alias("n"), F.col("component").alias("c"))
    a, c = (sized(named.withColumnsRenamed({"n": f"__{s}", "c": s}), m, f"__{s}") for s in "ab")
    dag = sized(sized(sized(adj, m, "src").join(a, F.col("src") == F.col("__a")), m, "dst").join(c, F.col("dst") == F.col("__b")).where("a != b").select("a", "b"), n, "a", "b").distinct()
    dag = cut_balanced(dag)
    edges = sized(dag, n, "a")
    reached = [sized(scc.select("component"), m, "component").distinct().select("component", F.lit(0).alias("depth"))]
    front = cut_balanced(sized(dag.select("b"), n, "b").distinct())
    while not front.isEmpty():
        reached.append(front.select("b", F.lit(len(reached)).alias("depth")))
        step = edges.join(sized(front.select(F.col("b").alias("__f")), n, "__f"), F.col("a") == F.col("__f"), "left_semi")
        front = cut_balanced(sized(step.select("b"), n, "b").distinct())
    return sized(reduce(DataFrame.union, reached), m, "component").groupBy("component").agg(F.max("depth").alias("depth"))


def propagation(files: DataFrame, reach: DataFrame | None, scc: DataFrame, adj: DataFrame) -> DataFrame:
    """One row: reachable and possible ordered pairs and their ratio, cyclic components and files, and the largest cycle."""
    n = files.agg(F.count(F.lit(1)).alias("source_files"))
    r = n.select(F.lit(None).cast("long").alias("reachable_pairs")) if reach is None else reach.where("src != dst").agg(F.count(F.lit(1)).alias("reachable_pairs"))
    cyc = cycles(scc, adj).agg(F.count(F.lit(1)).alias("cyclic_components"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("cyclic_files"), F.coalesce(F.max("size"), F.lit(0)).cast("long").alias("largest_cycle"))
    possible = F.col("source_files") * (F.col("source_files") - 1)
    out = n.crossJoin(F.broadcast(r)).crossJoin(F.broadcast(cyc)).withColumn("possible_pairs", possible)
    return out.withColumns({"propagation_fraction": ratio(F.col("reachable_pairs"), F.col("possible_pairs")), "cyclic_file_fraction": ratio(F.col("cyclic_files"), F.col("source_files")), "largest_cycle_fraction": ratio(F.col("largest_cycle"), F.col("source_files"))})


def hotspots(measured: DataFrame, pairs: tuple[tuple[str, str], ...], top: int = 5) -> DataFrame:
    """For each (primary, secondary) measure its top rows: primary and secondary downwards, then id; null and zero primaries do not count."""
    parts = []
    for primary, secondary in pairs:
        best = measured.where(F.coalesce(primary, F.lit(0)) != 0).orderBy(F.col(primary).desc(), F.col(secondary).desc_nulls_last(), "id").limit(top)
        parts.append(best.select(F.lit(primary).alias("measure"), "id", F.col(primary).alias("primary_value"), F.col(secondary).alias("secondary_value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out
