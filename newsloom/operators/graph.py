"""Entity co-occurrence graphs as edge and vertex tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.bounds import one_per_item, small_or_merge
from newsloom.operators.entities import frequency
from newsloom.session import materialize

BLOCK = 128
PAIRS = 500_000  # pairs of names that a task counts


def entity_pairs(articles: DataFrame, items: str, carry: Sequence[str] = ()) -> DataFrame:
    """All (source, target) pairs i < j of each article's entity list, with its sentiment.

    This is the full relationship list, one row per pair, meant for short lists; the
    weighted graph operators below never build it. Pairs stay within the row's task.
    """
    first = articles.filter(F.size(items) >= 2).select(
        *carry, F.col(items).alias("__items"), F.posexplode(items).alias("__i", "source"))
    rest = F.slice("__items", F.col("__i") + 2, F.size("__items"))
    return first.select(*carry, "source", F.explode(rest).alias("target"))


def pairs_per_article(articles: DataFrame, key: str, items: str) -> DataFrame:
    """(key, pairs): how many pairs ``entity_pairs`` has for each article, without making them."""
    n = F.size(items).cast("long")
    return articles.filter(F.size(items) >= 2).select(key, F.floor(n * (n - 1) / 2).alias("pairs"))


def _article_counts(articles: DataFrame, key: str, items: str) -> DataFrame:
    """(doc, blocks, entity, c): how often each article's list names each entity."""
    listed = articles.select(F.col(key).alias("doc"), F.col(items).alias("items"))
    blocks = F.ceil(F.size("items") / F.lit(BLOCK)).cast("int").alias("blocks")
    mentions = one_per_item(listed, "items", "entity", ["doc", blocks])
    return mentions.groupBy("doc", "blocks", "entity").agg(F.count("*").alias("c"))


def _blocked_pairs(counts: DataFrame) -> DataFrame:
    """(a, b): each pair of distinct names of an article once, a.entity < b.entity.

    Long lists are cut into blocks by hash. Every pair of blocks is its own group, so a
    huge article is paired by many tasks and no group holds more than two blocks.
    """
    block = F.pmod(F.xxhash64("entity"), F.col("blocks")).cast("int")
    placed = counts.withColumn("block", block).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    groups = placed.groupBy("doc", F.least("block", "other").alias("lo"),
                            F.greatest("block", "other").alias("hi")).agg(
        F.array_sort(F.collect_list(F.struct("entity", "block", "c"))).alias("members"))
    first = groups.select("lo", "hi", "members", F.posexplode("members").alias("i", "a"))
    both = first.select("lo", "hi", "a", F.explode(
        F.slice("members", F.col("i") + 2, F.size("members"))).alias("b"))
    # A group of two different blocks only answers for the pairs across them.
    return both.filter((F.col("lo") == F.col("hi")) | (F.col("a.block") != F.col("b.block"))
                       ).select("a", "b")


def _dealt(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """The pairs (src, dst, …) of an article's names in ``counts``, all rows of a pair in one task.

    The number of tasks follows from that of the pairs, which the lists' lengths give beforehand, so a
    task's table of pairs does not grow with the input.
    """
    n = F.count("*")
    total = counts.groupBy("doc").agg(F.ceil(n * (n + 1) / 2).alias("n")).agg(F.sum("n")).first()[0]
    return pairs.repartition(1 + (total or 0) // PAIRS, "src", "dst")


def edge_weights(articles: DataFrame, key: str, items: str) -> DataFrame:
    """Undirected (src, dst, weight): how many pairs of list entries name both, src <= dst.

    A pair of names travels once per article, weighted by its repetitions. A repeated name gives a
    loop of c(c-1)/2.
    """
    counts = materialize(_article_counts(articles, key, items), "counts")
    cross = _blocked_pairs(counts).select(
        F.col("a.entity").alias("src"), F.col("b.entity").alias("dst"),
        (F.col("a.c") * F.col("b.c")).alias("w"))
    loops = counts.filter("c > 1").select(
        F.col("entity").alias("src"), F.col("entity").alias("dst"),
        (F.col("c") * (F.col("c") - 1) / 2).cast("long").alias("w"))
    return _dealt(cross.unionByName(loops), counts).groupBy("src", "dst").agg(
        F.sum("w").alias("weight"))


def weighted_degree(articles: DataFrame, items: str) -> DataFrame:
    """(entity, degree) of the co-occurrence graph without building its edges.

    Each occurrence in a list of n entries takes part in n - 1 pairs, so the degree is the
    sum of n - 1 over occurrences: linear in the input however long a list is.
    """
    others = (F.size(items) - 1).cast("long").alias("others")
    rows = one_per_item(articles, items, "entity", [others])
    return rows.groupBy("entity").agg(F.sum("others").alias("degree")).filter("degree > 0")


def top_subgraph(articles: DataFrame, key: str, items: str, nodes: int = 20
                 ) -> tuple[DataFrame, DataFrame]:
    """(top nodes, edges among them) by weighted degree.

    The lists are cut to the top names before pairing: at most nodes² / 2 pairs per article,
    whatever its list's length.
    """
    top = weighted_degree(articles, items).orderBy(F.desc("degree"), "entity").limit(nodes)
    mentions = one_per_item(articles, items, "e", [F.col(key).alias("doc")])
    wanted = F.broadcast(top.select(F.col("entity").alias("e")))  # `nodes` rows
    counts = mentions.join(wanted, "e", "left_semi").groupBy("doc", "e").agg(
        F.count("*").alias("c"))
    lists = counts.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("e", "c"))).alias("n"))  # `nodes` entries
    first = lists.select("n", F.posexplode("n").alias("i", "a"))
    # Entry i with itself gives c(c-1)/2 pairs, with a later one c1*c2.
    both = first.select("a", F.explode(F.slice("n", F.col("i") + 1, F.size("n"))).alias("b"))
    same = F.col("a.e") == F.col("b.e")
    weight = F.when(same, (F.col("a.c") * (F.col("a.c") - 1) / 2).cast("long")).otherwise(
        F.col("a.c") * F.col("b.c"))
    edges = both.select(F.col("a.e").alias("src"), F.col("b.e").alias("dst"), weight.alias("w")
                        ).filter("w > 0").groupBy("src", "dst").agg(F.sum("w").alias("weight"))
    return top, edges


def graph_metrics(edges: DataFrame, articles: DataFrame) -> DataFrame:
    """Edge count, node count and number of articles analysed."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("entity")).agg(
        F.countDistinct("entity").alias("nodes"))
    return edges.agg(F.count("*").alias("edges")).withColumns({
        "nodes": ends.scalar(),
        "articles": articles.agg(F.count("*")).scalar(),
    })


# --- validated anchor graph ------------------------------------------------------------

def article_edges(articles: DataFrame, key: str, items: str, min_mentions: int = 5,
                  min_articles: int = 3, self_loops: bool = False) -> DataFrame:
    """(src, dst, weight): entity pairs that share at least ``min_articles`` articles.

    Only entities that can still be in such a pair are paired: those with enough mentions
    and in enough articles. Pairs are counted by the names' numbers. ``self_loops`` keeps the loop of a name that one article
    mentions twice.
    """
    counts = materialize(_article_counts(articles, key, items), "counts")
    usable = counts.groupBy("entity").agg(
        F.sum("c").alias("m"), F.count("*").alias("d")).filter(
        (F.col("m") >= min_mentions) & (F.col("d") >= min_articles)).select("entity")
    names = materialize(usable.withColumn("number", F.monotonically_increasing_id()), "names")
    kept = materialize(counts.join(small_or_merge(names), "entity").select(
        "doc", "blocks", F.col("number").alias("entity"), "c"), "kept")
    pairs = _blocked_pairs(kept).select(F.col("a.entity").alias("src"), F.col("b.entity").alias("dst"))
    edges = _dealt(pairs, kept).groupBy("src", "dst").agg(F.count("*").alias("weight"))
    if self_loops:
        loops = kept.filter("c > 1").groupBy(F.col("entity").alias("src")).agg(
            F.count("*").alias("weight")).select("src", F.col("src").alias("dst"), "weight")
        edges = edges.unionByName(loops)
    heavy = edges.filter(F.col("weight") >= min_articles)
    for end in ("src", "dst"):
        ends = names.select(F.col("number").alias(end), F.col("entity").alias(f"{end}_name"))
        heavy = heavy.join(small_or_merge(ends), end)
    return heavy.select(F.least("src_name", "dst_name").alias("src"),
                        F.greatest("src_name", "dst_name").alias("dst"), "weight")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("entity")).groupBy("entity").agg(
        F.count("*").alias("degree"))


def prune_leaves(edges: DataFrame, mentions: DataFrame, min_mentions: int = 10
                 ) -> tuple[DataFrame, DataFrame]:
    """One pass: drop nodes of degree 1 with fewer than ``min_mentions`` mentions.

    Returns the remaining nodes with their mentions and remaining degree (0 for a node
    whose neighbours all went) and the remaining edges.
    """
    nodes = degrees(edges).join(mentions, "entity", "left")
    leaf = (F.col("degree") == 1) & (F.coalesce("mentions", F.lit(0)) < min_mentions)
    gone = nodes.filter(leaf).select("entity")
    left = edges.join(gone, F.col("src") == F.col("entity"), "left_anti").join(
        gone, F.col("dst") == F.col("entity"), "left_anti")
    stay = nodes.filter(~leaf).select("entity", "mentions").join(
        degrees(left), "entity", "left").fillna(0, ["degree"])
    return stay, left


def degree_centrality(nodes: DataFrame) -> DataFrame:
    """degree / (n - 1); 1 for a graph of one node."""
    n = nodes.agg(F.count("*")).scalar()
    counted = nodes.withColumn("__n", n)
    return counted.withColumn("centrality", F.when(F.col("__n") <= 1, 1.0).otherwise(
        F.try_divide(F.col("degree").cast("double"), (F.col("__n") - 1).cast("double")))
    ).drop("__n")


def centrality_band(centrality):
    return (F.when(centrality >= 0.7, "key player").when(centrality >= 0.3, "secondary")
            .otherwise("peripheral"))


def anchor_scores(articles: DataFrame, key: str, items: str, min_mentions: int = 5,
                  min_articles: int = 3, leaf_mentions: int = 10) -> DataFrame:
    """(entity, mentions, degree, centrality, score) of the pruned anchor graph.

    score = mentions / most mentions of any entity * centrality. Edges and mentions are read
    several times, so they are written once.
    """
    mentions = materialize(frequency(articles, items), "mentions")
    edges = materialize(article_edges(articles, key, items, min_mentions, min_articles), "edges")
    nodes, _ = prune_leaves(edges, mentions, leaf_mentions)
    most = mentions.agg(F.max("mentions")).scalar()
    scored = degree_centrality(nodes).withColumn("__most", most)
    return scored.withColumn(
        "score", F.col("mentions") / F.col("__most") * F.col("centrality")).drop("__most")


def entity_types(mentions: DataFrame, entity: str = "text", label: str = "label") -> DataFrame:
    """Most frequent label per entity, ties by label."""
    counts = mentions.groupBy(F.col(entity).alias("entity"), F.col(label).alias("label")).agg(
        F.count("*").alias("n"))
    best = counts.groupBy("entity").agg(
        F.min(F.struct((-F.col("n")).alias("neg"), F.col("label"))).alias("b"))
    return best.select("entity", F.col("b.label").alias("label"))


def filter_nodes(nodes: DataFrame, min_connections: int = 0, label: str | None = None,
                 name_contains: str | None = None) -> DataFrame:
    out = nodes.filter(F.col("degree") >= min_connections)
    if label is not None:
        out = out.filter(F.col("label") == label)
    if name_contains:
        out = out.filter(F.lower("entity").contains(name_contains.lower()))
    return out
