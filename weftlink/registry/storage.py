"""Sources and sinks: what is written under the shared folder is read back and checked."""

from pyspark.sql import functions as F

from weftlink.operators.embedding import (
    HashBackend,
    current_vectors,
    embed_partitions,
    embed_works,
    leaf_path,
    pending,
    title_abstract_text,
)
from weftlink.registry.base import query, table
from weftlink.registry.texts import TITLED, titled
from weftlink.session import cut_lineage, scratch_path
from weftlink.sources.parquet import (
    compact,
    pack_vectors,
    read_tree,
    rebuild,
    replace_partitions,
    shard_number,
    unpack_vectors,
    with_file_name,
)


@query("hive_tree_round_trip", "SELECT doc_id, n_chars, lang, source FROM documents")
def hive_tree_round_trip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    root = rebuild(docs, scratch_path(spark, "tree"), ["lang"])
    return read_tree(spark, root, ["doc_id", "n_chars", "lang", "source"])


@query(
    "partition_replacement",
    "SELECT doc_id, CASE WHEN lang = 'fr' THEN 0 ELSE n_chars END AS n_chars, lang FROM documents",
)
def partition_replacement(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    root = rebuild(docs, scratch_path(spark, "replaced"), ["lang"])
    french = docs.filter("lang = 'fr'").withColumn("n_chars", F.lit(0).cast("long"))
    replace_partitions(french, root, ["lang"])
    return read_tree(spark, root, ["doc_id", "n_chars", "lang"])


@query("batch_from_file_name", "SELECT doc_id, CAST(doc_id % 16 AS INT) AS batch, true AS named FROM documents")
def batch_from_file_name(spark, sf_dir):
    """Shards under names with numbers; the number is read from where each row's file lies, and from nothing else."""
    name = F.format_string("shard-%05d.parquet", F.col("doc_id") % 16)
    docs = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    root = rebuild(docs, scratch_path(spark, "numbered"), ["name"])
    rows = with_file_name(read_tree(spark, root, ["doc_id", "_metadata"], flat=True))
    place = F.col("_metadata.file_path")
    return rows.select("doc_id", shard_number(place).alias("batch"), F.col("file_name").endswith(".parquet").alias("named"))


@query(
    "compaction_count_check",
    """SELECT doc_id, md5(text) AS digest, CAST(doc_id % 16 AS INT) AS batch, count(*) OVER () AS n_written FROM documents""",
)
def compaction_count_check(spark, sf_dir):
    """Numbered shards in folders, rewritten as few files: every row with its content and the number of its shard."""
    shards, target = scratch_path(spark, "shards"), scratch_path(spark, "compact")
    name = F.format_string("shard-%05d.parquet", F.col("doc_id") % 16)
    table(spark, sf_dir, "documents").select("doc_id", "text", name.alias("name")).write.partitionBy("name").parquet(shards)
    n = compact(spark, shards, target)
    return spark.read.parquet(target).select("doc_id", F.md5("text").alias("digest"), "batch", F.lit(n).cast("long").alias("n_written"))


@query(
    "wide_vector_round_trip",
    "SELECT vec_id, label, "
    + ", ".join(f"CAST(embedding[{i}] AS DOUBLE) AS V{i}" for i in range(1, 65))
    + " FROM embeddings",
)
def wide_vector_round_trip(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding")
    )
    width = rows.agg(F.max(F.size("embedding"))).first()[0]
    return unpack_vectors(pack_vectors(unpack_vectors(rows, width)), width)


@query(
    "incremental_embed_skip",
    f"""WITH {TITLED}
    SELECT count(*) AS stored, (SELECT count(*) FROM texts WHERE id IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)) AS pending_after_edit
    FROM texts""",
)
def incremental_embed_skip(spark, sf_dir):
    """Embed all, edit the labelled documents: only those are pending, a second run adds nothing."""
    docs = titled(spark, sf_dir)
    root = scratch_path(spark, "vectors")
    backend = HashBackend()
    first = embed_works(docs, root, "corpus", "test", "title_abstract", backend)
    again = embed_works(docs, root, "corpus", "test", "title_abstract", backend)
    if again:
        raise ValueError(f"{again} rows embedded twice, {first} the first time")
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("id"), F.lit(True).alias("edited"))
    edited = docs.join(labelled, "id", "left").withColumn(
        "abstract", F.when(F.col("edited"), F.concat("abstract", F.lit(" edited"))).otherwise(F.col("abstract"))
    )
    stored = spark.read.parquet(leaf_path(root, "test", "corpus", "title_abstract"))
    texts = title_abstract_text(docs, None, None)
    waiting = pending(title_abstract_text(edited, None, None), stored)
    return current_vectors(stored, texts).agg(F.count("*").alias("stored")).withColumn(
        "pending_after_edit", waiting.agg(F.count("*")).scalar()
    )


@query(
    "stale_model_pending",
    f"""WITH {TITLED}
    SELECT count(*) AS stored, count(*) AS pending_after_change, count(*) AS current_after_change FROM texts""",
)
def stale_model_pending(spark, sf_dir):
    """Embed all with one model, then with another under the same name: all texts are pending, then current again."""
    docs = titled(spark, sf_dir)
    root = scratch_path(spark, "models")
    old, new = HashBackend("old"), HashBackend("new", width=6)
    stored = embed_works(docs, root, "corpus", "test", "title_abstract", old)
    waiting = embed_works(docs, root, "corpus", "test", "title_abstract", new)
    vectors = spark.read.parquet(leaf_path(root, "test", "corpus", "title_abstract"))
    now = current_vectors(vectors, title_abstract_text(docs, None, None), new)
    return now.agg(F.count("*").alias("current_after_change")).select(
        F.lit(stored).cast("long").alias("stored"), F.lit(waiting).cast("long").alias("pending_after_change"), "current_after_change"
    )


@query(
    "damaged_leaf_again",
    f"""WITH {TITLED}, parts AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents),
      kept AS (SELECT t.id, p.lang FROM texts t JOIN parts p ON p.id = t.id)
    SELECT lang, count(*) AS stored, count(*) AS first_run, CASE WHEN lang = 'fr' THEN count(*) ELSE 0 END AS embedded_again,
           0 AS third_run FROM kept GROUP BY lang""",
)
def damaged_leaf_again(spark, sf_dir):
    """Embed documents by language, lose some French vectors: the next run embeds all French texts again, and no others."""
    docs = titled(spark, sf_dir)
    langs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "lang")
    works = cut_lineage(docs.join(langs, "id"))  # read by every run
    root = scratch_path(spark, "leaves")
    run = lambda model: embed_partitions(works, "lang", root, "corpus", "test", "title_abstract", HashBackend(model))
    leaf = leaf_path(root, "test", "corpus", "title_abstract")
    first = run("m")
    before = cut_lineage(spark.read.parquet(leaf).select("id", "lang", F.col("_metadata.file_path").alias("file")))
    # half of the French vectors are lost
    french = cut_lineage(spark.read.parquet(leaf).filter("lang = 'fr' and xxhash64(id) % 2 = 0"))
    replace_partitions(french, leaf, ["lang"])
    again = run("m")
    after = spark.read.parquet(leaf).select("id", "lang", F.col("_metadata.file_path").alias("file"))
    # files of partitions that were whole are the same as before
    moved = after.join(before, ["id", "lang", "file"], "left_anti").groupBy("lang").agg(F.count("*").alias("embedded_again"))
    if again != moved.agg(F.sum("embedded_again")).first()[0] or first != before.count():
        raise ValueError(f"{again} texts embedded again")
    third = run("m")
    counts = after.groupBy("lang").agg(F.count("*").alias("stored"))
    first_run = before.groupBy("lang").agg(F.count("*").alias("first_run"))
    rows = counts.join(first_run, "lang").join(moved, "lang", "left").fillna(0, ["embedded_again"])
    return rows.withColumn("third_run", F.lit(third))
