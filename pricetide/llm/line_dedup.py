"""Repeated runs of lines, found by winnowing over line hashes. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricetide.llm.common import NO_ID, stored

LEAST_WORDS = 50

# White space that separates words and surrounds lines (lines themselves end at a line feed).
BLANKS = "\t\x0b\f\r "


def _identity() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("text_hash")]


def line_windows(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text_hash, first, last, print, print_at, w1, w2): for each line that is not blank the shortest window of
    lines that starts there, and the shortest that ends there, of `least_words` words or more.

    first, last and print_at are line numbers of the text from 0. `print` is the smallest line hash of the window, at
    its first place there; w1 and w2 identify all lines of the window. Each line of a window has a word, so frames
    hold `least_words` lines at most.
    """
    blanks = F.lit(BLANKS)
    lines = docs.filter(F.length("text") > 0).select(*_identity(), F.posexplode(F.split("text", "\n")).alias("at", "line"))
    bare = lines.withColumn("bare", F.btrim("line", blanks)).filter("bare <> ''")
    counted = bare.select(
        "id", "text_hash", "at", F.xxhash64("bare").alias("h1"), F.xxhash64(F.lit("second"), "bare").alias("h2"),
        F.size(F.split("bare", "[\\t\\x0B\\f\\r ]+")).alias("words"))
    # Rows that repeat an id and its text are one document. Everything below stays in this partitioning.
    counted = counted.repartition("id", "text_hash").dropDuplicates(["id", "text_hash", "at"])
    doc = Window.partitionBy("id", "text_hash")
    upto = F.sum("words").over(doc.orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    counted = counted.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("words"))
    from_here = doc.orderBy("before").rangeBetween(0, least_words - 1)
    to_here = doc.orderBy("upto").rangeBetween(-(least_words - 1), 0)

    def window(frame) -> Column:
        lowest = F.min(F.struct("h1", "at")).over(frame)
        return F.struct(
            F.min("at").over(frame).alias("first"), F.max("at").over(frame).alias("last"), F.sum("words").over(frame).alias("words"),
            lowest["h1"].alias("print"), lowest["at"].alias("print_at"),
            F.xxhash64(F.collect_list("h1").over(frame)).alias("w1"), F.xxhash64(F.collect_list("h2").over(frame)).alias("w2"))

    both = counted.select("id", "text_hash", F.array_distinct(F.array(window(from_here), window(to_here))).alias("both"))
    return both.select("id", "text_hash", F.explode("both").alias("w")).select("id", "text_hash", "w.*").filter(F.col("words") >= least_words).drop("words")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, text_hash, runs): the lines of each document that lie in a run of lines, of `least_words` words or more,
    which occurred before, in order of id, then text hash, then line.

    Winnowing: two equal runs hold a whole equal window, and equal windows choose the same fingerprint. So a window
    whose fingerprint occurs at one place only is new, and most lines end there. What is left is joined with the first
    place of the same window. A match is extended line by line to both sides as long as the window that ends or starts
    with the next line has occurred before as well; matches that touch or overlap are one run.
    """
    windows = stored(line_windows(docs, least_words))
    prints = windows.select("id", "text_hash", "print", "print_at").distinct().groupBy("print").count().filter("count > 1")
    known = windows.join(prints.select("print"), "print", "left_semi")
    place = F.struct("id", "text_hash", "first")
    # Written first, so that the join below has a shuffle of its own and Spark can split a very common window.
    origin = stored(known.groupBy("w1", "w2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    matched = known.join(origin, ["w1", "w2"]).filter(place > F.col("origin")).select("id", "text_hash", "first", "last")
    doc = Window.partitionBy("id", "text_hash").orderBy("first", "last")
    reached = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.col("first") <= reached + 1, 0).otherwise(1)
    islands = matched.withColumn("apart", apart).withColumn("run", F.sum("apart").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = islands.groupBy("id", "text_hash", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def dedup_lines(docs: DataFrame, least_words: int = LEAST_WORDS, removed: str = "__removed") -> DataFrame:
    """The rows of `docs` with repeated runs deleted from `text`, and the number of deleted lines as column `removed`.

    Blank lines inside a repeated window go with it. Lines are equal if they are, without outer white space. A null text
    stays null, an empty one empty; repeated rows are one document and each keep what it keeps; null ids come last in
    the order. Columns other than doc_id and text are passed on, whatever their names.
    """
    runs = repeated_runs(docs.select("doc_id", "text"), least_words)
    runs = runs.select(F.col("id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("runs").alias("__runs"))
    ident, text_hash = _identity()
    joined = docs.join(runs, (ident == F.col("__id")) & (text_hash == F.col("__hash")), "left")
    lines = F.split("text", "\n")
    gone = lambda at: F.exists("__runs", lambda r: (r["first"] <= at) & (at <= r["last"]))
    left = F.when(F.col("__runs").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda _, at: ~gone(at)), "\n"))
    count = F.aggregate(F.coalesce("__runs", F.expr("array()")), F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1).cast("long")
    return joined.select(*[left.alias("text") if c == "text" else docs[c] for c in docs.columns], count.alias(removed))
