"""Queries for entity graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsloom.operators import boards, graph
from newsloom.operators import entities as en
from newsloom.plans.catalog import query
from newsloom.plans.tables import ART, MENTIONS, rounded
from newsloom.session import materialize

PAIRS = """pairs AS (SELECT id, sentiment, entities, entities[i] AS source, unnest(entities[i + 1:])
    AS target FROM (SELECT *, unnest(generate_series(1, len(entities))) AS i FROM art))"""


@query("k1_entity_pairs", f"""WITH {ART}, {PAIRS} SELECT id, sentiment, source, target FROM pairs""")
def _(t):
    rows = t.articles.select("id", F.col("sentiment").alias("mood"), "entities")
    return graph.entity_pairs(rows, "entities", ["id", "mood"]).withColumnRenamed(
        "mood", "sentiment").select("id", "sentiment", "source", "target")


@query("g6_pairs_per_document", f"""WITH {ART}, {PAIRS} SELECT id, count(*) AS pairs FROM pairs
  GROUP BY 1""")
def _(t):
    return graph.pairs_per_article(t.articles, "id", "entities")


# Weights over whole lists with repetitions: per article c1*c2, or c(c-1)/2 for one name.
COUNTS = f"""{ART}, l AS (SELECT id, entities FROM art WHERE len(entities) >= 2 AND {{filter}}),
  c AS (SELECT id, e, count(*) AS c FROM (SELECT id, unnest(entities) AS e FROM l) GROUP BY 1, 2),
  w AS (SELECT a.e AS src, b.e AS dst, sum(CASE WHEN a.e = b.e THEN a.c * (a.c - 1) // 2
      ELSE a.c * b.c END)::BIGINT AS weight FROM c a JOIN c b ON a.id = b.id AND a.e <= b.e
    GROUP BY 1, 2 HAVING weight > 0)"""
WEIGHTS = COUNTS.replace("{filter}", "true")


@query("k2_edge_weights", f"WITH {WEIGHTS} SELECT src, dst, weight FROM w")
def _(t):
    return graph.edge_weights(t.articles.select("id", "entities"), "id", "entities")


TOP = """d AS (SELECT e AS entity, sum(weight)::BIGINT AS degree FROM (SELECT src AS e, weight FROM w
    UNION ALL SELECT dst, weight FROM w) GROUP BY 1),
  top AS (SELECT * FROM d ORDER BY degree DESC, entity LIMIT 20),
  sub AS (SELECT src, dst, weight FROM w WHERE src IN (SELECT entity FROM top)
    AND dst IN (SELECT entity FROM top))"""


@query("k3_weighted_degree", f"WITH {WEIGHTS}, {TOP} SELECT entity, degree FROM d")
def _(t):
    return graph.weighted_degree(t.articles, "entities")


@query("g7_top_subgraph", f"WITH {WEIGHTS}, {TOP} SELECT src, dst, weight FROM sub")
def _(t):
    return graph.top_subgraph(t.articles, "id", "entities")[1]


@query("j7_top_relationships", f"""WITH {WEIGHTS}, {TOP} SELECT src, dst, weight FROM sub
  ORDER BY weight DESC, src, dst LIMIT 20""")
def _(t):
    edges = graph.top_subgraph(t.articles, "id", "entities")[1]
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(20)


@query("k10_graph_metrics", f"""WITH {WEIGHTS}, {TOP} SELECT count(*) AS edges,
  (SELECT count(DISTINCT e) FROM (SELECT src AS e FROM sub UNION SELECT dst FROM sub)) AS nodes,
  (SELECT count(*) FROM documents) AS articles FROM sub""")
def _(t):
    edges = graph.top_subgraph(t.articles, "id", "entities")[1]
    return graph.graph_metrics(edges, t("documents"))


# The anchor graph: distinct names per article, at least 3 shared articles.
ANCHOR = f"""{ART}, m AS (SELECT id, unnest(entities) AS e FROM art),
  f AS (SELECT e AS entity, count(*) AS mentions FROM (SELECT unnest(entities) AS e FROM art)
    GROUP BY 1),
  many AS (SELECT e FROM m GROUP BY 1 HAVING count(*) >= 5),
  p AS (SELECT DISTINCT id, e FROM m SEMI JOIN many USING (e)),
  edges AS (SELECT a.e AS src, b.e AS dst, count(*) AS weight FROM p a JOIN p b
    ON a.id = b.id AND a.e < b.e GROUP BY 1, 2 HAVING count(*) >= 3),
  deg AS (SELECT e AS entity, count(*) AS degree FROM (SELECT src AS e FROM edges UNION ALL
    SELECT dst FROM edges) GROUP BY 1),
  gone AS (SELECT entity FROM deg JOIN f USING (entity) WHERE degree = 1 AND mentions < 10),
  kept AS (SELECT * FROM edges WHERE src NOT IN (SELECT entity FROM gone)
    AND dst NOT IN (SELECT entity FROM gone)),
  left_deg AS (SELECT e AS entity, count(*) AS degree FROM (SELECT src AS e FROM kept UNION ALL
    SELECT dst FROM kept) GROUP BY 1),
  nodes AS (SELECT deg.entity, mentions, coalesce(left_deg.degree, 0) AS degree FROM deg
    JOIN f ON f.entity = deg.entity LEFT JOIN left_deg ON left_deg.entity = deg.entity
    WHERE deg.entity NOT IN (SELECT entity FROM gone)),
  scored AS (SELECT *, degree::DOUBLE / ((SELECT count(*) FROM nodes) - 1) AS centrality,
    mentions::DOUBLE / (SELECT max(mentions) FROM f) * (degree::DOUBLE /
      ((SELECT count(*) FROM nodes) - 1)) AS score FROM nodes)"""


def edges(t):
    return graph.article_edges(t.articles.select("id", "entities"), "id", "entities")


def pruned(t):
    """Nodes left after pruning; the edges are read several times, hence written once."""
    written = materialize(edges(t), "edges")
    return graph.prune_leaves(written, en.frequency(t.articles, "entities"))[0]


@query("k4_article_edges", f"WITH {ANCHOR} SELECT src, dst, weight FROM edges")
def _(t):
    return edges(t)


@query("k5_prune_leaves", f"WITH {ANCHOR} SELECT entity, mentions, degree FROM nodes")
def _(t):
    return pruned(t)


SCORED = "entity, mentions, degree, round(centrality, 8) AS centrality, round(score, 8) AS score"


def scored(t):
    out = graph.anchor_scores(t.articles.select("id", "entities"), "id", "entities")
    return out.withColumns({c: rounded(F.col(c), 8) for c in ("centrality", "score")})


@query("k6_degree_centrality", f"""WITH {ANCHOR} SELECT entity, round(centrality, 8) AS centrality
  FROM scored""")
def _(t):
    nodes = pruned(t)
    return graph.degree_centrality(nodes).select(
        "entity", rounded(F.col("centrality"), 8).alias("centrality"))


@query("k7_anchor_scores", f"WITH {ANCHOR} SELECT {SCORED} FROM scored")
def _(t):
    return scored(t)


@query("j6_top_anchors", f"""WITH {ANCHOR}, r AS (SELECT {SCORED} FROM scored)
  SELECT * FROM r ORDER BY score DESC, entity LIMIT 10""")
def _(t):
    return boards.top_by(scored(t), "score", "entity", 10)


TYPES = """types AS (SELECT text AS entity, label FROM (SELECT text, label, row_number() OVER (
    PARTITION BY text ORDER BY count(*) DESC, label) AS r FROM (SELECT text, CASE id % 3 WHEN 0
    THEN label ELSE 'ORG' END AS label FROM mentions) GROUP BY 1, 2) WHERE r = 1)"""


def types(t):
    """Mentions whose label depends on the article, so that labels compete."""
    label = F.when(F.col("id") % 3 == 0, F.col("label")).otherwise("ORG")
    return graph.entity_types(t.mentions.withColumn("label", label))


@query("k8_entity_types", f"WITH {MENTIONS}, {TYPES} SELECT entity, label FROM types")
def _(t):
    return types(t)


@query("k9_filter_nodes", f"""WITH {MENTIONS}, {TYPES}, {ANCHOR} SELECT entity, degree, label
  FROM nodes JOIN types USING (entity) WHERE degree >= 3 AND label = 'ORG'
  AND contains(lower(entity), 'th')""")
def _(t):
    nodes = pruned(t)
    typed = nodes.join(types(t), "entity")
    return graph.filter_nodes(typed, 3, "ORG", "Th").select("entity", "degree", "label")


@query("k11_centrality_band", f"""WITH {ANCHOR} SELECT CASE WHEN centrality >= 0.7 THEN 'key player'
  WHEN centrality >= 0.3 THEN 'secondary' ELSE 'peripheral' END AS band, count(*) AS n
  FROM scored GROUP BY 1""")
def _(t):
    nodes = pruned(t)
    band = graph.centrality_band(F.col("centrality"))
    return graph.degree_centrality(nodes).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
