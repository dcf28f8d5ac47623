"""Similarity, overlap, percentiles and links over the whole tables."""

from pyspark.sql import functions as F

from weftlink.operators.checks import missing_rows, stale_rows_dropped
from weftlink.operators.cluster import leaf_order
from weftlink.operators.cosine import (
    cosine_histogram,
    cosine_keyset_matrix,
    cosine_profile,
    cosine_top_links,
)
from weftlink.operators.figures import cell_style, palette_index
from weftlink.operators.jaccard import (
    cited_sets,
    jaccard_histogram,
    jaccard_keyset_matrix,
    jaccard_profile,
    jaccard_top_links,
    overlap_answers,
)
from weftlink.operators.links import grid_percentiles, linked_pairs
from weftlink.operators.midrank import add_percentile, midrank_table
from weftlink.registry.base import (
    CUSTOMER_PARTS,
    EDGES,
    ORDER_CITES,
    VECTORS,
    customer_parts,
    definitions,
    order_cites,
    query,
    table,
)
from weftlink.session import cut_lineage

TOP_TEXT, TOP_WORKS = 5, 3

RANKED_EDGES = f"""{EDGES},
  background AS (SELECT sim, count(*) AS n FROM edges GROUP BY sim),
  ranks AS (
    SELECT sim, (coalesce(sum(n) OVER (ORDER BY sim ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5)
             / sum(n) OVER () AS percentile
    FROM background),
  links AS (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY id_a, keyset_b ORDER BY sim DESC, id_b) AS link_rank
      FROM edges WHERE sim > 0) WHERE link_rank <= {TOP_TEXT})"""


def zero_padded(n_definitions: str) -> str:
    return f"""
  jseen AS (SELECT round(jaccard * 1e6) AS bin, count(*) AS n FROM jedges GROUP BY bin),
  jbackground AS (
    SELECT bin, sum(n) AS n FROM (
      SELECT bin, n FROM jseen
      UNION ALL
      SELECT 0, {n_definitions} * ({n_definitions} - 1) - (SELECT sum(n) FROM jseen)) GROUP BY bin),
  jranks AS (
    SELECT bin, (coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5)
             / sum(n) OVER () AS percentile
    FROM jbackground WHERE n > 0),
  jlinks AS (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY id_a, keyset_b ORDER BY jaccard DESC, id_b) AS link_rank
      FROM jedges) WHERE link_rank <= {TOP_WORKS})"""


@query(
    "cosine_edge_profile",
    f"""WITH {EDGES}
    SELECT id_a, keyset_b, count(*) AS n_edges, round(sum(sim), 6) AS sum_sim, min(sim) AS min_sim, max(sim) AS max_sim
    FROM edges GROUP BY id_a, keyset_b""",
)
def cosine_edge_profile(spark, sf_dir):
    profile = cosine_profile(definitions(spark, sf_dir), decimals=6)
    return profile.withColumn("sum_sim", F.round("sum_sim", 6))


@query(
    "self_similarity_profile",
    f"""WITH {VECTORS}
    SELECT a.id AS id_a, b.keyset AS keyset_b, count(*) AS n_edges, round(sum(s), 6) AS sum_sim,
           min(s) AS min_sim, max(s) AS max_sim
    FROM units a JOIN units b ON true,
         LATERAL (SELECT round(CAST(least(greatest(list_dot_product(a.e, b.e) / (a.len * b.len), -1), 1) AS DOUBLE), 6) AS s)
    GROUP BY a.id, b.keyset""",
)
def self_similarity_profile(spark, sf_dir):
    profile = cosine_profile(definitions(spark, sf_dir), decimals=6, self_pairs=True)
    return profile.withColumn("sum_sim", F.round("sum_sim", 6))


@query("self_similarity_leaf_order")
def self_similarity_leaf_order(spark, sf_dir):
    return leaf_order(definitions(spark, sf_dir))


@query(
    "cosine_top_links",
    f"""WITH {RANKED_EDGES}
    SELECT id_a, id_b, keyset_a, keyset_b, sim, link_rank FROM links""",
)
def top_links_by_text(spark, sf_dir):
    return cosine_top_links(definitions(spark, sf_dir), TOP_TEXT, decimals=6)


@query(
    "cosine_keyset_matrix",
    f"""WITH {EDGES}
    SELECT keyset_a, keyset_b, round(avg(raw_sim), 9) AS mean_value, count(*) AS n_pairs
    FROM edges GROUP BY keyset_a, keyset_b""",
)
def keyset_matrix_by_text(spark, sf_dir):
    return cosine_keyset_matrix(definitions(spark, sf_dir)).withColumn("mean_value", F.round("mean_value", 9))


@query(
    "cosine_background_midrank",
    f"""WITH {RANKED_EDGES}
    SELECT CAST(round(sim * 1e6) AS BIGINT) AS bin, percentile FROM ranks""",
)
def cosine_background_midrank(spark, sf_dir):
    return midrank_table(cosine_histogram(definitions(spark, sf_dir), decimals=6), decimals=6)


@query(
    "link_midrank_stage1",
    f"""WITH {RANKED_EDGES}
    SELECT id_a, id_b, sim, percentile, percentile >= 0.95 AS real_diff
    FROM links JOIN ranks USING (sim)""",
)
def link_midrank_stage1(spark, sf_dir):
    rows = definitions(spark, sf_dir)
    # stored: the links are read, and so are the bins they ask for
    links = cut_lineage(cosine_top_links(rows, TOP_TEXT, decimals=6).select("id_a", "id_b", "sim"))
    return add_percentile(links, "sim", cosine_histogram(rows, decimals=6), 6)


@query(
    "jaccard_edge_profile",
    f"""WITH {CUSTOMER_PARTS}
    SELECT id_a, count(*) AS n_edges, sum(n_shared) AS sum_shared, round(sum(jaccard), 6) AS sum_jaccard,
           max(jaccard) AS max_jaccard
    FROM jedges GROUP BY id_a""",
)
def jaccard_edge_profile(spark, sf_dir):
    profile = jaccard_profile(cited_sets(customer_parts(spark, sf_dir)))
    return profile.withColumn("sum_jaccard", F.round("sum_jaccard", 6))


@query(
    "jaccard_top_links",
    f"""WITH {CUSTOMER_PARTS}
    SELECT * FROM (
      SELECT id_a, id_b, n_shared, jaccard, keyset_a, keyset_b,
             row_number() OVER (PARTITION BY id_a, keyset_b ORDER BY jaccard DESC, id_b) AS link_rank
      FROM jedges) WHERE link_rank <= {TOP_WORKS}""",
)
def top_links_by_works(spark, sf_dir):
    return jaccard_top_links(cited_sets(customer_parts(spark, sf_dir)), TOP_WORKS)


@query(
    "jaccard_keyset_matrix",
    f"""WITH {CUSTOMER_PARTS},
      n AS (SELECT c_mktsegment AS keyset, count(*) AS n FROM customer GROUP BY c_mktsegment),
      totals AS (SELECT keyset_a, keyset_b, sum(jaccard) AS total FROM jedges GROUP BY keyset_a, keyset_b)
    SELECT a.keyset AS keyset_a, b.keyset AS keyset_b,
           round(coalesce(total, 0) / (a.n * b.n - CASE WHEN a.keyset = b.keyset THEN a.n ELSE 0 END), 9) AS mean_value,
           a.n * b.n - CASE WHEN a.keyset = b.keyset THEN a.n ELSE 0 END AS n_pairs
    FROM n a JOIN n b ON true LEFT JOIN totals t ON t.keyset_a = a.keyset AND t.keyset_b = b.keyset""",
)
def keyset_matrix_by_works(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("keyset"))
    matrix = jaccard_keyset_matrix(cited_sets(customer_parts(spark, sf_dir)), customers)
    return matrix.withColumn("mean_value", F.round("mean_value", 9))


@query(
    "link_midrank_stage2",
    f"""WITH {CUSTOMER_PARTS}, {zero_padded("(SELECT count(*) FROM customer)")}
    SELECT id_a, id_b, jaccard, percentile, percentile >= 0.95 AS real_diff
    FROM jlinks JOIN jranks ON bin = round(jaccard * 1e6)""",
)
def link_midrank_stage2(spark, sf_dir):
    sets = cited_sets(customer_parts(spark, sf_dir))
    found = overlap_answers(sets, TOP_WORKS, 6)
    background = jaccard_histogram(sets, table(spark, sf_dir, "customer").count(), 6, found)
    links = cut_lineage(jaccard_top_links(sets, TOP_WORKS, found).select("id_a", "id_b", "jaccard"))
    return add_percentile(links, "jaccard", background, 6)


LINKED_PAIRS = f"""{RANKED_EDGES}, {ORDER_CITES}, {zero_padded("(SELECT count(*) FROM embeddings)")},
  pairs AS (
    SELECT id_a, id_b, bool_or(t) AS top_stage1, bool_or(NOT t) AS top_stage2
    FROM (SELECT id_a, id_b, true AS t FROM links UNION ALL
          SELECT id_a, id_b, false FROM jlinks) GROUP BY id_a, id_b),
  linked AS (
    SELECT p.*, e.keyset_a, e.keyset_b, e.sim, coalesce(j.n_shared, 0) AS n_shared, coalesce(j.jaccard, 0) AS jaccard,
           r1.percentile AS percentile_stage1, r2.percentile AS percentile_stage2,
           r1.percentile >= 0.95 AS real_diff_stage1, r2.percentile >= 0.95 AS real_diff_stage2,
           (r1.percentile + r2.percentile) / 2 AS combined,
           CAST(r1.percentile >= 0.95 AS INT) + CAST(r2.percentile >= 0.95 AS INT) AS n_agree
    FROM pairs p JOIN edges e USING (id_a, id_b) LEFT JOIN jedges j USING (id_a, id_b)
    JOIN ranks r1 ON r1.sim = e.sim JOIN jranks r2 ON r2.bin = round(coalesce(j.jaccard, 0) * 1e6))"""


def linked(spark, sf_dir):
    return linked_pairs(definitions(spark, sf_dir), order_cites(spark, sf_dir), TOP_WORKS)


@query(
    "linked_pairs_combined",
    f"""WITH {LINKED_PAIRS.replace(f"link_rank <= {TOP_TEXT}", f"link_rank <= {TOP_WORKS}")}
    SELECT * FROM linked""",
)
def linked_pairs_combined(spark, sf_dir):
    return linked(spark, sf_dir)


@query(
    "linked_pairs_workflow",
    f"""WITH {EDGES.replace("6) AS sim", "12) AS sim")}, {ORDER_CITES}, {zero_padded("(SELECT count(*) FROM embeddings)")},
  binned AS (SELECT CAST(round(sim * 1e6) AS BIGINT) AS bin, count(*) AS n FROM edges GROUP BY bin),
  ranks AS (
    SELECT bin, (coalesce(sum(n) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n * 0.5)
             / sum(n) OVER () AS percentile
    FROM binned),
  links AS (
    SELECT * FROM (
      SELECT *, row_number() OVER (PARTITION BY id_a, keyset_b ORDER BY sim DESC, id_b) AS link_rank
      FROM edges WHERE sim > 0) WHERE link_rank <= {TOP_TEXT}),
  alllinks AS (
    SELECT id_a, id_b FROM links
    UNION
    SELECT id_a, id_b FROM (
      SELECT *, row_number() OVER (PARTITION BY id_a, keyset_b ORDER BY jaccard DESC, id_b) AS link_rank
      FROM jedges) WHERE link_rank <= {TOP_TEXT})
    SELECT p.id_a, p.id_b, round(e.sim, 9) AS sim, coalesce(j.jaccard, 0) AS jaccard,
           r1.percentile AS percentile_stage1, r2.percentile AS percentile_stage2,
           CAST(r1.percentile >= 0.95 AS INT) + CAST(r2.percentile >= 0.95 AS INT) AS n_agree
    FROM alllinks p JOIN edges e USING (id_a, id_b) LEFT JOIN jedges j USING (id_a, id_b)
    JOIN ranks r1 ON r1.bin = CAST(round(e.sim * 1e6) AS BIGINT)
    JOIN jranks r2 ON r2.bin = round(coalesce(j.jaccard, 0) * 1e6)""",
)
def linked_pairs_workflow(spark, sf_dir):
    """Linked pairs with the settings of the stored workflow: 12 decimals, percentiles in bins."""
    rows = linked_pairs(definitions(spark, sf_dir), order_cites(spark, sf_dir), TOP_TEXT, decimals=12)
    return rows.select(
        "id_a", "id_b", F.round("sim", 9).alias("sim"), "jaccard", "percentile_stage1", "percentile_stage2", "n_agree"
    )


def _channel_sql(i: int) -> str:
    from weftlink.operators.figures import GRADIENT, KNOTS

    levels = [int(c[1 + 2 * i : 3 + 2 * i], 16) for c in GRADIENT]
    cases = " ".join(
        f"WHEN percentile_stage1 < {KNOTS[k + 1]} THEN {levels[k]} + (percentile_stage1 - {KNOTS[k]}) "
        f"/ {KNOTS[k + 1] - KNOTS[k]} * {levels[k + 1] - levels[k]}"
        for k in range(4)
    )
    return f"CAST(round(CASE {cases} ELSE {levels[4]} END) AS INT)"


@query(
    "linked_pairs_cells",
    f"""WITH {LINKED_PAIRS.replace(f"link_rank <= {TOP_TEXT}", f"link_rank <= {TOP_WORKS}")},
      rgb AS (SELECT *, {_channel_sql(0)} AS r, {_channel_sql(1)} AS g, {_channel_sql(2)} AS b FROM linked),
      toned AS (
        SELECT *, CASE WHEN 0.2126 * r / 255 + 0.7152 * g / 255 + 0.0722 * b / 255 > 0.5 THEN 'black' ELSE 'white' END AS tone
        FROM rgb)
    SELECT id_a, id_b, printf('#%02X%02X%02X', r, g, b) AS fill, tone AS text_color,
           ['neither', 'one', 'both'][n_agree + 1] AS agreement, ['none', 'dashed', 'solid'][n_agree + 1] AS border,
           CASE WHEN real_diff_stage1 THEN 'bold' ELSE 'plain' END AS face_stage1,
           CASE WHEN real_diff_stage2 THEN 'bold' ELSE 'plain' END AS face_stage2,
           CASE WHEN real_diff_stage1 THEN tone WHEN tone = 'white' THEN 'grey80' ELSE 'grey45' END AS color_stage1,
           CASE WHEN real_diff_stage2 THEN tone WHEN tone = 'white' THEN 'grey80' ELSE 'grey45' END AS color_stage2
    FROM toned""",
)
def linked_pairs_cells(spark, sf_dir):
    return cell_style(linked(spark, sf_dir)).select(
        "id_a", "id_b", "fill", "text_color", "agreement", "border", "face_stage1", "face_stage2", "color_stage1",
        "color_stage2",
    )


@query(
    "stale_embedding_semi",
    "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels)",
)
def stale_embedding_semi(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    current = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("vec_id"))
    return stale_rows_dropped(vectors, current, "vec_id")


@query(
    "missing_embedding_anti",
    "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
)
def missing_embedding_anti(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return missing_rows(table(spark, sf_dir, "documents"), vectors, "doc_id")


@query(
    "palette_index",
    """SELECT p_partkey, CAST(floor((p_retailprice - lo) / (hi - lo) * 255) + 1 AS INT) AS palette_step
    FROM part, (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)""",
)
def palette_steps(spark, sf_dir):
    return palette_index(table(spark, sf_dir, "part"), "p_retailprice").select("p_partkey", "palette_step")


@query(
    "pair_grid_percentiles",
    f"""WITH {RANKED_EDGES}, {ORDER_CITES}, {zero_padded("(SELECT count(*) FROM embeddings)")},
  meta AS (
    SELECT id, keyset, CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN 'Short ' || id
             WHEN CAST(id AS BIGINT) % 3 = 1 THEN 'C' || id || ' Title of ' || id ELSE 'Title of ' || id END AS label FROM vectors),
  grid AS (
    SELECT a.id AS id_a, b.id AS id_b, a.label AS label_a, b.label AS label_b FROM meta a JOIN meta b
      ON a.keyset = (SELECT min(keyset) FROM vectors) AND b.keyset IN ((SELECT min(keyset) FROM vectors), (SELECT max(keyset) FROM vectors))),
  cells AS (
    SELECT g.*, coalesce(e.sim, 0) AS sim, coalesce(j.n_shared, CASE WHEN g.id_a = g.id_b THEN s.n END, 0) AS n_shared, coalesce(j.jaccard, 0) AS jaccard
    FROM grid g LEFT JOIN edges e USING (id_a, id_b) LEFT JOIN jedges j USING (id_a, id_b) LEFT JOIN sizes s ON s.id = g.id_a),
  total AS (SELECT count(*) AS n FROM edges),
  ranked AS (
    SELECT c.*, coalesce(r1.percentile, (SELECT count(*) FROM edges e WHERE e.sim < 0) / CAST((SELECT n FROM total) AS DOUBLE)) AS percentile_stage1,
           r2.percentile AS percentile_stage2
    FROM cells c LEFT JOIN ranks r1 ON r1.sim = c.sim JOIN jranks r2 ON r2.bin = round(c.jaccard * 1e6))
    SELECT *, percentile_stage1 >= 0.95 AS real_diff_stage1, percentile_stage2 >= 0.95 AS real_diff_stage2,
           (percentile_stage1 + percentile_stage2) / 2 AS combined,
           CAST(percentile_stage1 >= 0.95 AS INT) + CAST(percentile_stage2 >= 0.95 AS INT) AS n_agree FROM ranked""",
)
def pair_grid_percentiles(spark, sf_dir):
    """The first keyset against itself and the last one, every cell with both values, ranks and labels."""
    rows = definitions(spark, sf_dir)
    third = F.pmod(F.col("id").cast("long"), F.lit(3))
    meta = rows.select(
        "id", "keyset", F.concat(F.lit("Title of "), "id").alias("title"),
        F.when(third == 1, F.concat(F.lit("C"), "id")).otherwise("").alias("code"),
        F.when(third == 0, F.concat(F.lit("Short "), "id")).alias("short_name"),
    )
    ends = rows.agg(F.min("keyset").alias("low"), F.max("keyset").alias("high")).first()
    first = rows.filter(F.col("keyset") == ends.low).select("id")
    both = rows.filter(F.col("keyset").isin(ends.low, ends.high)).select("id")
    return grid_percentiles(rows, order_cites(spark, sf_dir), meta, first, both)
