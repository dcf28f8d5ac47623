"""Axis places, dividers and curves."""

from pyspark.sql import functions as F

from weftlink.operators.cosine import cosine_top_links
from weftlink.operators.figures import curve_points, diagram_links, even_places, group_boundaries, link_nodes
from weftlink.plans.ordering import with_dense_position, with_position
from weftlink.registry.base import definitions, query, table
from weftlink.registry.linkage import RANKED_EDGES, TOP_TEXT
from weftlink.session import cut_lineage


@query(
    "axis_dense_rank",
    """SELECT p_partkey, p_name, dense_rank() OVER (ORDER BY p_name) AS xn, dense_rank() OVER (ORDER BY p_type DESC) AS yn
    FROM part""",
)
def axis_dense_rank(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    placed = with_dense_position(with_dense_position(part, "p_name", "xn"), "p_type", "yn", descending=True)
    return placed.select("p_partkey", "p_name", "xn", "yn")


@query(
    "axis_even_places",
    """SELECT p_partkey, CASE WHEN count(*) OVER () <= 1 THEN 0.5
      ELSE round(0.98 - (row_number() OVER (ORDER BY p_name, p_partkey) - 1) * (CAST(0.96 AS DOUBLE) / (count(*) OVER () - 1)), 9) END AS y
    FROM part""",
)
def axis_even_places(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return even_places(part, ["p_name", "p_partkey"]).select("p_partkey", F.round("y", 9).alias("y"))


@query(
    "group_boundary_lag",
    """SELECT group_before, group_after, yn - 0.5 AS line_at FROM (
      SELECT p_brand AS group_after, lag(p_brand) OVER (ORDER BY p_name, p_partkey) AS group_before,
             row_number() OVER (ORDER BY p_name, p_partkey) AS yn FROM part)
    WHERE group_before <> group_after""",
)
def group_boundary_lag(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    axis = with_position(part, ["p_name", "p_partkey"], "yn")
    return group_boundaries(axis, "yn", "p_brand")


@query("global_row_id", "SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS row_id FROM documents")
def global_row_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return with_position(docs, [F.desc("n_chars"), F.asc("doc_id")], "row_id").select("doc_id", "row_id")


@query(
    "sankey_curve_points",
    f"""WITH {RANKED_EDGES},
      places AS (
        SELECT id, CAST(0.98 AS DOUBLE) - (row_number() OVER (ORDER BY id) - 1) * (CAST(0.96 AS DOUBLE) / (count(*) OVER () - 1)) AS y FROM vectors)
    SELECT id_a, id_b, CAST(i AS INT) AS point, round(i / CAST(39 AS DOUBLE), 9) AS x,
           round(a.y + (b.y - a.y) * (i / CAST(39 AS DOUBLE)) * (i / CAST(39 AS DOUBLE)) * (3 - 2 * i / CAST(39 AS DOUBLE)), 9) AS y
    FROM links JOIN places a ON a.id = id_a JOIN places b ON b.id = id_b, range(40) r(i)""",
)
def sankey_curve_points(spark, sf_dir):
    rows = definitions(spark, sf_dir)
    places = cut_lineage(even_places(rows.select("id"), ["id"]))
    links = (
        cosine_top_links(rows, TOP_TEXT, decimals=6)
        .select("id_a", "id_b")
        .join(places.toDF("id_a", "y0"), "id_a")
        .join(places.toDF("id_b", "y1"), "id_b")
        .withColumns({"x0": F.lit(0.0), "x1": F.lit(1.0)})
    )
    points = curve_points(links)
    return points.select("id_a", "id_b", "point", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


PARTS = """SELECT p_partkey AS id, p_brand AS keyset,
      CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE lower(p_name) END || ' ' || p_type AS label FROM part"""


def parts(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_name")).otherwise(F.lower("p_name"))
    label = F.concat(name, F.lit(" "), "p_type")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("keyset"), label.alias("label"))


@query(
    "link_diagram_nodes",
    f"""SELECT keyset, id, label, substr(label, 1, 30) AS label_short, place,
      CASE WHEN n <= 1 THEN 0.5 ELSE round(0.98 - (place - 1) * (CAST(0.96 AS DOUBLE) / (n - 1)), 9) END AS y
    FROM (SELECT *, row_number() OVER (PARTITION BY keyset ORDER BY label COLLATE NOCASE, label, id) AS place,
                 count(*) OVER (PARTITION BY keyset) AS n FROM ({PARTS}))""",
)
def link_diagram_nodes(spark, sf_dir):
    """Every part as a node of its brand's axis, labels in an order that takes small and capital letters alike."""
    return link_nodes(parts(spark, sf_dir), "UTF8_LCASE").withColumn("y", F.round("y", 9))


@query(
    "link_diagram_curves",
    f"""WITH {RANKED_EDGES},
      placed AS (
        SELECT keyset, id, row_number() OVER (PARTITION BY keyset ORDER BY id) AS place, count(*) OVER (PARTITION BY keyset) AS n FROM vectors),
      nodes AS (
        SELECT keyset, id, CASE WHEN n <= 1 THEN 0.5 ELSE CAST(0.98 AS DOUBLE) - (place - 1) * (CAST(0.96 AS DOUBLE) / (n - 1)) END AS y FROM placed),
      ends AS (SELECT min(keyset) AS low, max(keyset) AS high FROM vectors)
    SELECT id_a, id_b, link_rank, round(a.y, 9) AS y0, round(b.y, 9) AS y1
    FROM links JOIN ends ON keyset_a = low AND keyset_b = high
    JOIN nodes a ON a.keyset = keyset_a AND a.id = id_a JOIN nodes b ON b.keyset = keyset_b AND b.id = id_b""",
)
def link_diagram_curves(spark, sf_dir):
    """Top links from the first keyset to the last, between places inside each of them."""
    rows = definitions(spark, sf_dir)
    ends = rows.agg(F.min("keyset").alias("low"), F.max("keyset").alias("high")).first()
    nodes = cut_lineage(link_nodes(rows.select("keyset", "id", F.col("id").alias("label"))))
    drawn = diagram_links(cosine_top_links(rows, TOP_TEXT, decimals=6), nodes, ends.low, ends.high)
    return drawn.select("id_a", "id_b", "link_rank", F.round("y0", 9).alias("y0"), F.round("y1", 9).alias("y1"))
