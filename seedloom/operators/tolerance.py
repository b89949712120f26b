"""Tree walks and nucleotide tolerance scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedloom.operators.joins import by_key
from seedloom.operators.trees import map_trees

# Names of the weight schemes.
PARAMS = ("0", "0_MinNode", "0_MinNode_Mix", "0_MinNode_Mix2", "mean", "median", "X", "CountNodes_1", "CountNodes_2", "CountNodes_3", "CountNodes_4", "Equal")


def leaf_distances(edges: DataFrame) -> DataFrame:
    """``query_id, node, is_leaf, is_query, distance, hops`` from each tree's query leaf to every node.

    ``edges`` has ``query_id, node, parent, branch_length, is_leaf, is_query``. A node's hops count
    the nodes from the query's parent to it, that parent being 1; a leaf takes its parent's. Trees are small; each is walked once.
    """

    def walk(rows: list[dict]) -> list[tuple]:
        parent = {r["node"]: r["parent"] for r in rows}
        leaf = {r["node"]: r["is_leaf"] for r in rows}
        start = next(r["node"] for r in rows if r["is_query"] == 1)
        near: dict[int, list[tuple[int, float]]] = {n: [] for n in parent}
        for r in rows:
            if r["parent"] is not None:
                near[r["node"]].append((r["parent"], r["branch_length"] or 0.0))
                near[r["parent"]].append((r["node"], r["branch_length"] or 0.0))
        distance, hops, queue = {start: 0.0}, {start: 0}, [start]
        for n in queue:
            for other, step in near[n]:
                if other not in distance:
                    distance[other], hops[other] = distance[n] + step, hops[n] + 1
                    queue.append(other)
        return [(n, int(leaf[n]), int(n == start), distance[n], hops[parent[n]] if leaf[n] and n != start else hops[n]) for n in parent if n in distance]

    return map_trees(edges, ("node", "parent", "branch_length", "is_leaf", "is_query"), walk, "node int, is_leaf int, is_query int, distance double, hops int")


def tree_distances(trees: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`leaf_distances` of trees as ``readers.read_newick`` gives them, from the leaf that ``queries`` (``query_id, seq_id``) names for each.

    Names must be equal, not parts of each other. Raises ``ValueError`` for trees whose leaf is absent or there more than once.
    """
    named = trees.join(by_key(queries.select("query_id", F.col("seq_id").alias("_named"))), "query_id")
    marked = named.withColumn("is_query", F.when((F.col("is_leaf") == 1) & (F.col("label") == F.col("_named")), 1).otherwise(0)).drop("_named")
    wrong = marked.groupBy("query_id").agg(F.sum("is_query").alias("n")).where("n <> 1").orderBy("query_id").limit(10).collect()
    if wrong:
        raise ValueError("query leaves not found once: " + ", ".join(f"{r['query_id']} ({r['n']})" for r in wrong))
    return leaf_distances(marked.drop("label"))


def orient_edges(edges: DataFrame, distances: DataFrame) -> DataFrame:
    """Internal edges with their ``far`` and ``near`` end from the query; at equal distance the parent is far."""
    inner = edges.where("is_leaf = 0 and parent is not null").select("query_id", "node", "parent")
    own = distances.select("query_id", "node", F.col("distance").alias("own"))
    up = distances.select("query_id", F.col("node").alias("parent"), F.col("distance").alias("up"))
    joined = inner.join(by_key(own), ["query_id", "node"]).join(by_key(up), ["query_id", "parent"])
    parent_far = F.col("up") >= F.col("own")
    return joined.select("query_id", F.when(parent_far, F.col("parent")).otherwise(F.col("node")).alias("far"), F.when(parent_far, F.col("node")).otherwise(F.col("parent")).alias("near"))


def scheme_weight(param: str, least: float | None = None) -> Column:
    """A node's weight under one scheme, over the columns of :func:`leaf_distances`; ``least`` is needed by the threshold schemes only."""
    tree = Window.partitionBy("query_id")
    d, h = F.col("distance"), F.col("hops")
    leaf_min = F.min(F.when((F.col("is_leaf") == 1) & (F.col("is_query") == 0), d)).over(tree)
    node_min = F.min(F.when(F.col("is_leaf") == 0, d)).over(tree)
    mean = F.avg(d).over(tree)
    if param == "0":
        w = 1 / (d / leaf_min + 1)
    elif param == "0_MinNode":
        w = 1 / (d / node_min + 1)
    elif param in ("0_MinNode_Mix", "0_MinNode_Mix2"):
        mixed = 1 / (d / node_min + 1) * F.exp(-d * d / (mean * mean))
        w = F.sqrt(mixed if param == "0_MinNode_Mix" else mixed / 2)
    elif param == "mean":
        w = F.exp(-d * d / (mean * mean))
    elif param == "median":
        middle = F.percentile(d, F.lit(0.5)).over(tree)
        w = F.exp(-d * d / (middle * middle))
    elif param == "X":
        w = F.when(F.col("is_query") == 1, 1.0).otherwise(F.exp(-d * d) / 2)
    elif param == "CountNodes_1":
        w = (F.exp(-d * d) + 1 / F.nullif(h, F.lit(0))) / 2
    elif param == "CountNodes_2":
        w = (F.exp(-d * d) + F.exp((-h * h).cast("double"))) / 2
    elif param == "CountNodes_3":
        w = F.sqrt(F.exp(-d * d) / F.nullif(h, F.lit(0)))
    elif param == "CountNodes_4":
        w = F.exp(-d * h)
    elif param == "Equal":
        w = F.lit(1.0)
    elif param in ("MinThreshold", "MinThreshold_Gauss"):
        if least is None:
            raise ValueError(f"{param} needs its least weight")
        most = F.max(d).over(tree)
        w = (least - 1) / most * d + 1 if param == "MinThreshold" else F.exp(d * d * F.log(F.lit(least)) / (most * most))
    else:
        sigma = float(param)
        w = F.exp(-d * d / (sigma * sigma))
    return F.when(F.col("is_query") == 1, F.coalesce(w, F.lit(1.0))).otherwise(w)


def distance_weights(distances: DataFrame, param: str, least: float | None = None) -> DataFrame:
    """``query_id, node, weight`` under one weight scheme; see :func:`scheme_weight`."""
    return distances.select("query_id", "node", scheme_weight(param, least).alias("weight"))


def gap_aware_posterior(nucleotides: DataFrame, gaps: DataFrame) -> DataFrame:
    """Base probabilities times that of no gap, by ``query_id, node, site``."""
    joined = nucleotides.join(by_key(gaps), ["query_id", "node", "site"])
    rest = [c for c in joined.columns if c not in ("p_a", "p_c", "p_g", "p_t", "p_0")]
    return joined.select(*rest, *((F.col(c) * (1 - F.col("p_0"))).alias(c) for c in ("p_a", "p_c", "p_g", "p_t")))


def tolerance_scores(edges: DataFrame, distances: DataFrame, posterior: DataFrame, msa: DataFrame, param: str = "mean", norm: str = "NN", least: float | None = None) -> DataFrame:
    """``query_id, site`` and, for each base, the score with leaves (``wl_*``) and without (``wol_*``).

    Weights depend on the tree only and are computed once a node. All joins share
    ``query_id`` first; what they give is summed by query and site before the parts meet.
    ``msa`` has ``query_id, leaf, site, nt`` with anything but A, C, G, T as a gap.
    """
    weights = distance_weights(distances, param, least)
    bases = ("a", "c", "g", "t")
    query = distances.where("is_query = 1").select("query_id", F.col("node").alias("leaf"))
    query_nt = msa.join(by_key(query), ["query_id", "leaf"]).select("query_id", "site", F.upper("nt").alias("qnt"))

    def probabilities(node: str, tag: str) -> DataFrame:
        return by_key(posterior.select("query_id", F.col("node").alias(node), "site", *(F.col(f"p_{b}").alias(f"{tag}_{b}") for b in bases)))

    oriented = orient_edges(edges, distances).join(by_key(weights.withColumnRenamed("node", "far")), ["query_id", "far"])
    inner = oriented.join(probabilities("far", "f"), ["query_id", "far"]).join(probabilities("near", "n"), ["query_id", "near", "site"])
    parts = [inner.select("query_id", "site", F.lit(0).alias("leafy"), *((F.col("weight") * F.greatest(F.lit(0.0), F.col(f"f_{b}") - F.col(f"n_{b}"))).alias(b) for b in bases))]

    leaves = edges.where("is_leaf = 1").select("query_id", F.col("node").alias("leaf"), F.col("parent"))
    root = leaves.join(by_key(query), ["query_id", "leaf"]).select("query_id", F.col("parent").alias("node"))
    at_root = root.join(by_key(weights), ["query_id", "node"]).join(probabilities("node", "p"), ["query_id", "node"]).join(by_key(query_nt), ["query_id", "site"])
    parts.append(at_root.select("query_id", "site", F.lit(0).alias("leafy"), *((F.when(F.col("qnt") == b.upper(), 0.0).otherwise(F.col("weight") * F.col(f"p_{b}"))).alias(b) for b in bases)))
    own = query.join(by_key(weights.withColumnRenamed("node", "leaf")), ["query_id", "leaf"]).select("query_id", "weight").join(by_key(query_nt), "query_id")
    parts.append(own.select("query_id", "site", F.lit(0).alias("leafy"), *(F.when(F.col("qnt") == b.upper(), F.col("weight")).otherwise(0.0).alias(b) for b in bases)))

    others = leaves.join(by_key(query), ["query_id", "leaf"], "left_anti").join(by_key(weights.withColumnRenamed("node", "leaf")), ["query_id", "leaf"])
    others = others.join(by_key(msa.where(F.upper("nt").isin("A", "C", "G", "T"))), ["query_id", "leaf"]).join(probabilities("parent", "p"), ["query_id", "parent", "site"])
    parts.append(others.select("query_id", "site", F.lit(1).alias("leafy"), *(F.when(F.upper("nt") == b.upper(), F.col("weight") * F.greatest(F.lit(0.0), 1 - F.col(f"p_{b}"))).otherwise(0.0).alias(b) for b in bases)))

    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    sums = whole.groupBy("query_id", "site").agg(*(F.sum(b).alias(f"wl_{b}") for b in bases), *(F.sum(F.when(F.col("leafy") == 0, F.col(b)).otherwise(0.0)).alias(f"wol_{b}") for b in bases))
    if norm == "raw":
        return sums
    if norm == "NN":
        sizes = edges.groupBy("query_id").agg(F.count("*").cast("double").alias("by_wl"), F.count_if(F.col("is_leaf") == 0).cast("double").alias("by_wol"))
        scaled = sums.join(by_key(sizes), "query_id")
    elif norm == "FN":
        code = lambda c: F.when(F.upper(c).isin("A", "C", "G", "T"), F.upper(c)).otherwise("-")
        same = msa.join(by_key(query_nt), ["query_id", "site"]).groupBy("query_id", "site").agg(F.count_if(code(F.col("nt")) == code(F.col("qnt"))).cast("double").alias("by_wl"))
        scaled = sums.join(by_key(same), ["query_id", "site"]).withColumn("by_wol", F.col("by_wl"))
    else:
        raise ValueError(f"unknown normalisation {norm!r}")
    return scaled.select("query_id", "site", *((F.col(f"{k}_{b}") / F.col(f"by_{k}")).alias(f"{k}_{b}") for k in ("wl", "wol") for b in bases))


#: Sites that one group of joined rows spans: a query of any length is as many groups.
RANGE_SITES = 256
#: Letters that one task of the score table is dealt, with the states and nodes of their trees.
TASK_LETTERS = 250_000
LEAF_MODES = ("wl", "wol")
NORMS = ("NN", "FN", "raw")
# Letters in the order of the score files, and the name that files give a scheme.
LETTERS = ("A", "T", "G", "C")
FILE_NAMES = {"X": "max05_Gauss"}


def tree_nodes(edges: DataFrame, distances: DataFrame, params: list[tuple[str, float | None]]) -> DataFrame:
    """``query_id, node, parent, is_leaf, is_query, far, weights, up_weights, n_inner, n_nodes``: one row a node, all that scores need of a tree.

    ``weights`` has the node's weight under each scheme of ``params`` (name and least weight), ``up_weights`` its parent's;
    ``far`` tells whether the parent is the end of the edge farther from the query, as at equal distance.
    """
    weighted = distances.select("query_id", "node", "distance", "is_query", F.array(*(scheme_weight(p, least) for p, least in params)).alias("weights"))
    up = weighted.select("query_id", F.col("node").alias("parent"), F.col("distance").alias("up"), F.col("weights").alias("up_weights"))
    sizes = edges.groupBy("query_id").agg(F.count("*").cast("double").alias("n_nodes"), F.count_if(F.col("is_leaf") == 0).cast("double").alias("n_inner"))
    joined = edges.select("query_id", "node", "parent", "is_leaf").join(by_key(weighted), ["query_id", "node"]).join(by_key(up), ["query_id", "parent"], "left").join(by_key(sizes), "query_id")
    return joined.select("query_id", "node", "parent", "is_leaf", "is_query", (F.col("up") >= F.col("distance")).alias("far"), "weights", "up_weights", "n_inner", "n_nodes")


def site_range(site: str, sites: int) -> Column:
    return F.floor((F.col(site) - 1) / sites).cast("int")


def score_table(
    edges: DataFrame, distances: DataFrame, posterior: DataFrame, msa: DataFrame, params: list[tuple[str, float | None]], norms: tuple[str, ...] = NORMS, range_sites: int = RANGE_SITES
) -> DataFrame:
    """``query_id, site, param, norm, leaf_mode, A, T, G, C``: tolerance scores of every site under all schemes, norms and leaf modes at once.

    ``params`` are names of weight schemes with their least weight (threshold schemes only). What a scheme changes is a node's weight, so nodes carry
    an array of weights through one pass: states, leaves and nodes are dealt once by query and range of ``range_sites`` sites, meet their node and the
    state of their parent there, every scheme is a sum of its own by query and site, and norms and leaf modes are made of those sums. A tree's few nodes
    are sent to each of its ranges, so that a long query is many even groups. ``posterior`` and ``msa`` are as in :func:`tolerance_scores`; sites without
    the query leaf's letter give no row.
    """
    unknown = set(norms) - set(NORMS)
    if unknown or not norms or not params:
        raise ValueError(f"unknown normalisation {sorted(unknown)}" if unknown else "no scheme or norm is asked for")
    bases = ("a", "c", "g", "t")
    spanned = lambda df: df.withColumn("span", site_range("site", range_sites))
    states = spanned(posterior.select("query_id", "node", "site", F.array(*(F.col(f"p_{b}") for b in bases)).alias("p")))
    code = F.when(F.upper("nt").isin(*LETTERS), F.upper("nt")).otherwise("-")
    letters = spanned(msa.select("query_id", F.col("leaf").alias("node"), "site", code.alias("nt")))
    nodes = tree_nodes(edges, distances, params)
    about = F.struct("parent", "is_leaf", "is_query", "far", "weights", "up_weights", "n_inner", "n_nodes").alias("about")
    nodes = nodes.join(by_key(letters.select("query_id", "span").distinct()), "query_id").select("query_id", "span", "node", about)
    rows = states.where("site is not null").unionByName(letters.where("site is not null"), True).unionByName(nodes, True)
    rows = rows.repartition(max(1, -(-msa.count() // TASK_LETTERS)), "query_id", "span")
    # A node stands before its states and letters, a parent's state before those of its children: none of them is exchanged again, and sums have one order.
    at_node = Window.partitionBy("query_id", "span", "node").orderBy(F.col("site").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    known = rows.withColumn("about", F.first("about").over(at_node)).where("site is not null")
    inner, leafy = F.col("about.is_leaf") == 0, F.col("about.is_leaf") == 1
    role = F.when(F.col("nt").isNull() & inner & F.col("about.parent").isNotNull(), 0).when(F.col("nt").isNotNull() & leafy, F.when(F.col("about.is_query") == 1, 1).otherwise(2))
    known = known.withColumn("role", role)
    weight = F.when((F.col("role") == 0) & ~F.col("about.far"), F.col("about.weights")).when(F.col("role") <= 1, F.col("about.up_weights")).otherwise(F.col("about.weights"))
    child = {"parent": F.col("about.parent"), "role": F.col("role"), "node": F.col("node"), "p": F.col("p"), "nt": F.col("nt"), "far": F.col("about.far"), "w": weight}
    child |= {"own_w": F.when(F.col("role") == 1, F.col("about.weights")), "n_inner": F.col("about.n_inner"), "n_nodes": F.col("about.n_nodes")}
    as_child = F.struct(*(v.alias(n) for n, v in child.items()))
    above = {"parent": F.col("node"), "role": F.lit(-1), "p": F.col("p")}
    as_parent = F.struct(*(above.get(n, F.lit(None)).alias(n) for n in child))
    both = F.when(F.col("role").isNull(), F.array(as_parent)).when(F.col("role") == 0, F.array(as_parent, as_child)).otherwise(F.array(as_child))
    family = Window.partitionBy("query_id", "span", "parent", "site").orderBy("role", "node").rowsBetween(Window.unboundedPreceding, 0)
    met = known.where("role is not null or nt is null").select("query_id", "span", "site", F.inline(both))
    met = met.withColumn("q", F.first(F.when(F.col("role") == -1, F.col("p"))).over(family)).where("role >= 0")
    # Of each child row: the four values that its weights are multiplied by.
    zero = F.lit(0.0)
    own = [F.col("nt") == b.upper() for b in bases]
    up, mine = [F.get("q", F.lit(i)) for i in range(4)], [F.get("p", F.lit(i)) for i in range(4)]
    edge = [F.when(F.col("far"), F.greatest(zero, u - m)).otherwise(F.greatest(zero, m - u)) for u, m in zip(up, mine)]
    root = [F.when(is_own, zero).otherwise(u) for is_own, u in zip(own, up)]
    leaf = [F.when(is_own, F.greatest(zero, 1 - u)).otherwise(zero) for is_own, u in zip(own, up)]
    parts = met.select(
        "query_id", "span", "site", "role", "n_inner", "n_nodes", "nt", "w", "own_w",
        *(F.when(F.col("role") == 0, e).when(F.col("role") == 1, r).otherwise(v).alias(f"v_{b}") for b, e, r, v in zip(bases, edge, root, leaf)),
    )
    sums = []
    for k in range(len(params)):
        w, own_w = F.get("w", F.lit(k)), F.get("own_w", F.lit(k))
        for i, b in enumerate(bases):
            # The query's own letter counts with its own weight instead of its parent's state.
            value = w * F.col(f"v_{b}") + F.when((F.col("role") == 1) & own[i], own_w).otherwise(0.0)
            sums += [F.sum(F.when(F.col("role") < 2, value)).alias(f"i_{k}_{b}"), F.sum(F.when(F.col("role") == 2, value)).alias(f"l_{k}_{b}")]
    query_nt = F.max(F.when(F.col("role") == 1, F.col("nt"))).alias("qnt")
    counts = [F.count_if((F.col("role") > 0) & (F.col("nt") == c)).alias(f"n_{i}") for i, c in enumerate((*LETTERS, "-"))]
    whole = parts.groupBy("query_id", "span", "site").agg(*sums, query_nt, *counts, F.max("n_inner").alias("n_inner"), F.max("n_nodes").alias("n_nodes")).where("qnt is not null")
    same = F.lit(0.0)
    for i, c in enumerate((*LETTERS, "-")):
        same = F.when(F.col("qnt") == c, F.col(f"n_{i}").cast("double")).otherwise(same)
    # First a row a scheme, then one a norm and leaf mode: neither step grows with the product of all.
    by_scheme = [
        F.struct(F.lit(param).alias("param"), *(F.coalesce(F.col(f"i_{k}_{b}"), zero).alias(f"i_{b}") for b in bases), *(F.coalesce(F.col(f"l_{k}_{b}"), zero).alias(f"l_{b}") for b in bases))
        for k, (param, _) in enumerate(params)
    ]
    schemes = whole.withColumn("same", same).select("query_id", "site", "same", "n_inner", "n_nodes", F.inline(F.array(*by_scheme)))
    rows = []
    for norm in norms:
        for mode in LEAF_MODES:
            by = {"raw": F.lit(1.0), "FN": F.col("same"), "NN": F.col("n_nodes" if mode == "wl" else "n_inner")}[norm]
            total = {x: F.col(f"i_{x.lower()}") + F.col(f"l_{x.lower()}") if mode == "wl" else F.col(f"i_{x.lower()}") for x in LETTERS}
            rows.append(F.struct(F.lit(norm).alias("norm"), F.lit(mode).alias("leaf_mode"), *((total[x] / by).alias(x) for x in LETTERS)))
    return schemes.select("query_id", "site", "param", F.inline(F.array(*rows)))


def log_transform_score(score: Column) -> Column:
    """``1 - ln(x + 1e-10) / ln(1e-10)``."""
    return 1 - F.log(score + 1e-10) / F.log(F.lit(1e-10))


def query_nt_count(msa: DataFrame, query_leaf: int | DataFrame) -> DataFrame:
    """Leaves that carry the query leaf's letter, by query and site; the leaf is one number, or ``query_id, leaf`` rows."""
    own = msa.where(F.col("leaf") == query_leaf) if isinstance(query_leaf, int) else msa.join(by_key(query_leaf.select("query_id", "leaf")), ["query_id", "leaf"], "left_semi")
    return msa.join(by_key(own.select("query_id", "site", F.col("nt").alias("qnt"))), ["query_id", "site"]).groupBy("query_id", "site").agg(F.count_if(F.col("nt") == F.col("qnt")).alias("n_same"))
