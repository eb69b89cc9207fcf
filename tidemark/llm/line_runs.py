"""Line dedup by a suffix array over line ids (operator 1), in DataFrame operations only.

A document is the sequence of its lines that hold a word; equal lines are
equal ids. Prefix doubling orders all suffixes of all documents: the rank of a
suffix by its first 2^(h+1) lines is the rank of the pair (rank at the suffix,
rank 2^h lines on) by its first 2^h. Pairs are counted before they are ranked,
ranks are the row ids of a range-sorted table of distinct pairs, and suffixes
whose pair is found once leave: no earlier or later text shares that many of
their lines. Suffixes of equal rank at level h are an interval of the suffix
array whose longest common prefix is at least 2^h lines; its occurrences but
the first, by document and line, are later copies. A run of L lines is covered
by its two windows of the largest power of two within L, so the intervals of
all levels together mark exactly the lines of maximal repeated runs.

A later copy is deleted if it has two lines or more, or is one line of
``min_bytes`` UTF-8 bytes or more: a sentence has few code points in some scripts. Lines without a word stay and don't part a run.

Null and empty texts have no lines and stay. Rows with null ``doc_id`` stay
whole and take no part. Rows with equal id and text count as one document and
get the same result; rows with equal id and other text are documents of their
own, ordered by a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import settle

PLACE = ["doc_id", "row_id", "seq"]
WORD = r"[^\x20\x09-\x0D]"


def _real_lines(text: Column) -> Column:
    """Lines that hold a word, each with its place among all lines of the text."""
    every = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("i"), x.alias("line")))
    return F.filter(every, lambda s: s["line"].rlike(WORD))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text")).withColumn("row_id", F.xxhash64("text"))


def _named(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows whose ``by`` is found twice or more, with its rank and its first place."""
    found = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("first")).where("n > 1").drop("n")
    ranked = settle(found.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("rank", F.monotonically_increasing_id()))
    return rows.join(ranked, by)


def later_copies(docs: DataFrame, min_bytes: int = 40) -> DataFrame:
    """(doc_id, row_id, seq, length) of windows of lines that an earlier place has too, over the levels of the suffix array."""
    lines = _keyed(docs).where("doc_id is not null").select("doc_id", "row_id", F.posexplode(_real_lines(F.col("text"))).alias("seq", "s"))
    rows = lines.select(
        "doc_id", "row_id", F.col("seq").cast("bigint").alias("seq"), F.xxhash64("s.line").alias("a"), F.xxhash64(F.lit(7), F.col("s.line")).alias("b"),
        (F.octet_length("s.line") >= min_bytes).alias("long"),
    )
    level, marks = 0, []
    rows = settle(_named(rows, ["a", "b"]).select(*PLACE, "rank", "first", "long"))
    later = F.struct(*PLACE) > F.col("first")
    marks.append(rows.where(later & F.col("long")).select(*PLACE, F.lit(1).cast("bigint").alias("length")))
    while not rows.isEmpty():
        reach = 1 << level
        ahead = Window.partitionBy("doc_id", "row_id").orderBy("seq").rangeBetween(reach, reach)
        pairs = rows.select(*PLACE, F.col("rank").alias("a"), F.max("rank").over(ahead).alias("b")).where("b is not null")
        level += 1
        rows = settle(_named(pairs, ["a", "b"]).select(*PLACE, "rank", "first"))
        marks.append(rows.where(later).select(*PLACE, F.lit(1 << level).cast("bigint").alias("length")))
    out = marks[0]
    for more in marks[1:]:
        out = out.unionByName(more)
    return out


def _deleted_runs(marks: DataFrame) -> DataFrame:
    """Per document, the stretches of lines under any mark, as an array of (lo, hi)."""
    here = Window.partitionBy("doc_id", "row_id").orderBy("seq")
    reach = F.max(F.col("seq") + F.col("length")).over(here.rowsBetween(Window.unboundedPreceding, -1))
    best = marks.groupBy(*PLACE).agg(F.max("length").alias("length"))
    cut = best.withColumn("open", (F.coalesce(reach, F.lit(-1)) < F.col("seq")).cast("int"))
    cut = cut.withColumn("run", F.sum("open").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    runs = cut.groupBy("doc_id", "row_id", "run").agg(F.min("seq").alias("lo"), F.max(F.col("seq") + F.col("length") - 1).alias("hi"))
    return runs.groupBy("doc_id", "row_id").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("runs"))


def without_later_copies(docs: DataFrame, min_bytes: int = 40) -> DataFrame:
    """``docs`` (any columns) with ``text`` less its later copies, and n_lines, n_removed, n_runs.

    A document in which nothing is deleted keeps its text as it is, null included.
    Columns of ``docs`` with the names of added or helper columns are replaced.
    """
    docs = docs.drop("n_lines", "n_removed", "n_runs", "_row_id", "_doc", "_row", "_runs", "_real", "_gone")
    runs = _deleted_runs(later_copies(docs, min_bytes)).toDF("_doc", "_row", "_runs")
    keyed = docs.withColumn("_row_id", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = keyed.join(runs, (keyed["doc_id"].cast("bigint") == runs["_doc"]) & (keyed["_row_id"] == runs["_row"]), "left")
    real = _real_lines(F.coalesce(F.col("text").cast("string"), F.lit("")))

    def places(run: Column) -> Column:
        part = F.slice(F.col("_real"), (run["lo"] + 1).cast("int"), (run["hi"] - run["lo"] + 1).cast("int"))
        return F.transform(part, lambda s: s["i"])

    gone = F.flatten(F.transform(F.col("_runs"), places))
    both = both.withColumn("_real", real).withColumn("_gone", F.when(F.col("_runs").isNotNull(), gone))
    every = F.split("text", "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col("_gone"))  # by hash, in order
    kept = F.array_join(F.transform(left, lambda i: F.get(every, i)), "\n")
    size = F.coalesce(F.aggregate("_runs", F.lit(0).cast("bigint"), lambda t, r: t + r["hi"] - r["lo"] + 1), F.lit(0).cast("bigint"))
    out = both.withColumn("n_lines", F.size("_real").cast("bigint")).withColumn("n_removed", size)
    out = out.withColumn("n_runs", F.coalesce(F.size("_runs"), F.lit(0)).cast("bigint")).withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(kept))
    return out.select(*docs.columns, "n_lines", "n_removed", "n_runs")
