"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, n_docs, target) from rows of (source, size).

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes; no target exceeds ``most`` times its source's size. Resharing the excess until
    none is above ends where target = min(cap, level * weight) with the one level that
    spends everything; in order of cap / weight it follows from running sums.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    by = by.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    # a row for each source: few, whatever the number of documents
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = rising.rowsBetween(Window.unboundedPreceding, -1)
    rest = rising.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn(
        "level",
        (F.sum("source_size").over(every).cast("double") - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("weight").over(rest),
    )
    # the level holds from the first source that it does not fill; where all are filled, caps
    by = by.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(every)["level"])
    return by.select("source", "source_size", "n_docs", F.when(F.col("level").isNull() | (F.col("cap") <= F.col("level") * F.col("weight")), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row.

    A document is expected target / source_size times. Within its source, in order of size
    (so that neighbours are alike) and then of a keyed digest of doc_id, the expected copies
    are prefix-summed; with one offset for the source, it is emitted once for each integer
    the sum passes. The offset is a digest of the source, so reruns agree.

    ``carry`` names narrow columns to pass through, each with ``_`` before its name; other columns
    are not read, and very long texts only counted. A null text has size 0, a null source is a source of its own; a source without words has
    target 0 and its documents are not taken. Repeated rows of one doc_id follow each other
    in the order, each counts for itself; rows without doc_id are ordered by their carried columns.
    An empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    more = [f"_{c}" for c in carry]
    rows = docs.select("doc_id", "source", size.alias("size"), *[F.col(c).alias(f"_{c}") for c in carry])
    # rows without doc_id are told apart by what is carried
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat_ws(",", *[F.col(c).cast("string") for c in more]) if more else F.lit(""))
    rows = written(rows.withColumn("digest", F.md5(F.concat(F.lit(seed), name))), "sizes")
    targets = source_targets(rows, weights, most)

    # Ranks within a source without bringing a source into one task: rows of one source and
    # size are a bucket, cut by digest where they are many. Buckets are counted, the counts
    # prefix-summed, and only within a bucket are rows ranked.
    buckets = rows.groupBy("source", "size").agg(F.ceil(F.count("*") / BUCKET_ROWS).alias("parts"))
    head = F.conv(F.substring("digest", 1, 7), 16, 10).cast("long")
    rows = _join(rows, buckets, "source", "size").withColumn("part", F.floor(head * F.col("parts") / F.lit(16**7)))
    counts = rows.groupBy("source", "size", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("size", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    counts = _join(counts, targets, "source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce("source", F.lit("")))), 1, 5), 16, 10).cast("double") / F.lit(2.0**20)
    within = Window.partitionBy("source", "size", "part").orderBy("digest", "doc_id", *more)
    rank = (F.col("earlier") + F.row_number().over(within)).cast("double")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (
        _join(rows, counts, "source", "size", "part")
        .withColumn("rank", rank)
        .withColumn("each", each)
        .withColumn("offset", offset)
        .withColumn("copies", F.least(F.floor(F.col("offset") + F.col("each") * F.col("rank")) - F.floor(F.col("offset") + F.col("each") * (F.col("rank") - 1)), F.lit(most)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *more)
    )


def _join(left: DataFrame, right: DataFrame, *on: str) -> DataFrame:
    """An inner join on columns of which source may be null."""
    other = right.select(*[F.col(c).alias(f"_{c}" if c in on else c) for c in right.columns])
    match = left["source"].eqNullSafe(other["_source"])
    for c in on[1:]:
        match &= left[c] == other[f"_{c}"]
    return left.join(other, match).drop(*[f"_{c}" for c in on])


#: The same in DuckDB's dialect.
SQL = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5(concat('mix', coalesce(doc_id::VARCHAR, ''))) AS digest
  FROM documents),
by_source AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source),
weighted AS (
  SELECT *, 1.0::DOUBLE + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) AS weight, 3.0::DOUBLE * source_size AS cap
  FROM by_source),
levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighted),
chosen AS (
  SELECT own_level AS level FROM levels WHERE own_level * weight < cap ORDER BY cap / weight, source NULLS LAST LIMIT 1),
targets AS (
  SELECT source, source_size,
         CASE WHEN level IS NULL OR cap <= level * weight THEN cap ELSE level * weight END AS target
  FROM levels LEFT JOIN chosen ON true),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, digest, doc_id)::DOUBLE AS rnk FROM sizes),
placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target, r.rnk,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
         ('0x' || substr(md5(concat('mix', coalesce(r.source, ''))), 1, 5))::BIGINT::DOUBLE / 1048576.0 AS shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (least(floor(shift + each * rnk) - floor(shift + each * (rnk - 1)), 3) * size)::BIGINT AS taken
FROM placed
"""
