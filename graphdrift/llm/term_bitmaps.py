"""Frequency of every distinct value or term, in a vertical layout of record-identifier bitmaps.

Every snapshot (the record) gets an integer id; ids follow the order of (repo_id, commit_hash) so that the snapshots of a
repository lie together. A term's set of record ids is a bitmap kept as sparse 64-bit words, one row (term, word_no, word)
for each word that is not zero: empty stretches cost nothing, and the bitmap of the most frequent term is spread over rows
instead of being one growing value in one task. Words are built map-side with bit_or beside an occurrence counter, partial
bitmaps merge by union (bit_or again), and the document frequency of a term is the cardinality of its words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import module_name
from ..plans.runtime import cut, lookup

#: A term in fewer snapshots than this is rare.
RARE_BELOW = 3
#: A term in more than this share of the table's snapshots is common.
COMMON_ABOVE = 0.4


def _key(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("\x00"))


def record_ids(*tables: DataFrame) -> DataFrame:
    """(r1, r2, record_id, in_0, in_1, ...): an id for each distinct (repo_id, commit_hash), and the tables that hold it.

    Null keys are a value of their own. Ids are unique and nearly consecutive within a range of the sort order; the table is
    checkpointed so that a retried task cannot number anew.
    """
    flags = [f"in_{i}" for i in range(len(tables))]
    rows = None
    for i, t in enumerate(tables):
        one = t.select(_key("repo_id").alias("r1"), _key("commit_hash").alias("r2"), *[F.lit(int(j == i)).alias(f) for j, f in enumerate(flags)])
        rows = one if rows is None else rows.unionByName(one)
    one = rows.groupBy("r1", "r2").agg(*[F.max(f).alias(f) for f in flags])
    ordered = one.repartitionByRange("r1", "r2").sortWithinPartitions("r1", "r2")
    return cut(ordered.withColumn("record_id", F.monotonically_increasing_id()))


def vertical(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """(field_name, term, word_no, word, occurrences) of rows (r1, r2, field_name, term); null terms are none."""
    bit = F.expr("shiftleft(1L, cast(record_id & 63 AS int))")
    return (
        rows.where("term IS NOT NULL")
        .join(lookup(ids.select("r1", "r2", "record_id")), ["r1", "r2"])
        .groupBy("field_name", "term", F.shiftright("record_id", 6).alias("word_no"))
        .agg(F.bit_or(bit).alias("word"), F.count("*").alias("occurrences"))
    )


def frequencies(bitmaps: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, snapshots) from the words of each term."""
    return bitmaps.groupBy("field_name", "term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum(F.bit_count("word")).cast("bigint").alias("snapshots")
    )


def value_frequencies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(field_name, term, occurrences, snapshots, mark) of to_module and importer_count over all stored rows.

    Terms are module names in normal form and counts in decimal; null or blank values are no terms but their snapshots
    count. mark is 'rare', 'common' or null. Empty tables give no rows; repeated rows count as occurrences.
    """
    ids = record_ids(edges, nodes)
    rows = edges.select(
        _key("repo_id").alias("r1"), _key("commit_hash").alias("r2"), F.lit("to_module").alias("field_name"), module_name(F.col("to_module")).alias("term")
    ).unionByName(
        nodes.select(
            _key("repo_id").alias("r1"), _key("commit_hash").alias("r2"), F.lit("importer_count").alias("field_name"), F.col("importer_count").cast("string").alias("term")
        )
    )
    n = ids.agg(F.sum("in_0").alias("n0"), F.sum("in_1").alias("n1")).first()
    total = F.when(F.col("field_name") == "to_module", F.lit(n["n0"] or 0)).otherwise(F.lit(n["n1"] or 0))
    mark = F.when(F.col("snapshots") < RARE_BELOW, "rare").when(F.col("snapshots") > total * F.lit(COMMON_ABOVE), "common")
    return frequencies(vertical(rows, ids)).withColumn("mark", mark)
