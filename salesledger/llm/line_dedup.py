"""Line deduplication by winnowing over line hashes, DataFrame functions only.

A window is the least run of consecutive lines from a line on, or up to a
line, that has ``MIN_WORDS`` words. Winnowing selects the least line hash of each
window, and the places of these minima are the document's fingerprints. Windows
depend on their own lines alone, so two places that share a run of that many words
select the same fingerprint at the same line of it.

Positions are joined by their fingerprint; those whose fingerprint stands at one
place alone go no further. The others are extended both ways: a position reaches
left and right over each window that selected it, and every reach is held against
the same reach of the other positions of its fingerprint. Of positions that agree
on a reach the first (by doc_id, then position) keeps it, all later ones lose its
lines. The reaches from each line on and up to each line cover a shared run to
its very ends. A reach is matched on its own, with its own first copy: where a run
W is followed by x in the first copy and by t in the second and third, an
extension that only follows the first copy of the fingerprint would keep the t of
the third.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.common import WORD_SPACE, freeze, n_words

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, pos, h, c, b): lines with a word; c and b count the
    document's words up to the line's end and start."""
    exploded = docs.select("doc_id", "rid", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = exploded.select("doc_id", "rid", "pos", F.xxhash64(F.btrim("line", F.lit(WORD_SPACE))).alias("h"), n_words(F.col("line")).alias("words")).where("words > 0")
    again = Window.partitionBy("doc_id", "rid", "pos").orderBy("h")  # rows that repeat a whole document count once
    upto = Window.partitionBy("doc_id", "rid").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    once = lines.repartition("doc_id", "rid").withColumn("again", F.row_number().over(again)).where("again = 1").drop("again")
    return once.withColumn("c", F.sum("words").over(upto)).withColumn("b", F.col("c") - F.col("words"))


def _positions(lines: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, rid, pos, h, reaches): the selected minima, each with the windows
    that selected it, (first, last, words, lines, key). At most ``min_words``
    windows start, and as many end, around a position."""
    doc = Window.partitionBy("doc_id", "rid")
    on = doc.orderBy("b").rangeBetween(0, min_words - 1)
    upto = doc.orderBy("c").rangeBetween(-(min_words - 1), 0)

    def window(frame, words):
        return F.struct(
            F.min("pos").over(frame).alias("first"), F.max("pos").over(frame).alias("last"), words.alias("words"),
            F.collect_list("h").over(frame).alias("hs"), F.min(F.struct("h", "pos")).over(frame).alias("least"),
        )

    both = lines.select(
        "doc_id", "rid",
        window(on, F.max("c").over(on) - F.col("b")).alias("x"),
        window(upto, F.col("c") - F.min("b").over(upto)).alias("y"),
    )
    same = (F.col("x.first") == F.col("y.first")) & (F.col("x.last") == F.col("y.last"))
    found = both.select("doc_id", "rid", F.explode(F.when(same, F.array("x")).otherwise(F.array("x", "y"))).alias("w")).where(F.col("w.words") >= min_words)
    reach = F.struct(F.col("w.first").alias("first"), F.col("w.last").alias("last"), F.col("w.words").alias("words"), F.size("w.hs").alias("lines"), F.xxhash64("w.hs").alias("key"))
    selected = found.select("doc_id", "rid", F.col("w.least.pos").alias("pos"), F.col("w.least.h").alias("h"), reach.alias("reach"))
    return selected.groupBy("doc_id", "rid", "pos", "h").agg(F.collect_list("reach").alias("reaches"))


def _shared(positions: DataFrame) -> DataFrame:
    """The positions whose fingerprint stands at two places or more."""
    place = F.struct("doc_id", "rid", "pos")
    again = freeze(positions.groupBy("h").agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select("h"))
    return positions.join(again, "h", "left_semi")


def _extended(positions: DataFrame) -> DataFrame:
    """(h, doc_id, rid, first, last, words, lines, key): every reach of every position."""
    return positions.select("h", "doc_id", "rid", F.inline("reaches"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, rid, gone): for documents (doc_id, rid, text) with later
    copies of runs, the places of the lines to delete."""
    positions = freeze(_positions(_lines(docs), min_words))
    matches = freeze(_extended(_shared(positions)))
    start = F.struct("doc_id", "rid", "first")
    alike = ["h", "key", "lines", "words"]
    firsts = freeze(matches.groupBy(*alike).agg(F.min(start).alias("kept"), F.max(start).alias("z")).where("kept <> z").select(*alike, "kept"))
    later = matches.join(firsts, alike).where(start != F.col("kept"))
    gone = later.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    each = F.transform("runs", lambda r: F.sequence(r["first"], r["last"]))
    return gone.select("doc_id", "rid", F.array_distinct(F.flatten(each)).alias("gone"))


def remove_repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` (doc_id, text, any others) with later copies of runs of lines
    deleted from ``text``, and the columns n_lines and removed_lines (longs;
    columns of these names are replaced).

    A run is consecutive lines with ``min_words`` words or more, equal after
    trimming white space; lines without words neither match nor break a
    run; inside a window that goes they go with it.
    The first copy by (doc_id, then a hash of the text, then position) stays;
    null doc_ids come first. A null text stays null with zero lines; a text may
    become empty, its row stays. Rows that repeat doc_id and text count as one
    document and are cleaned alike.
    """
    text = F.col("text").cast("string")
    keyed = docs.drop("n_lines", "removed_lines").withColumn("_rid", F.xxhash64(text))
    gone = repeated_lines(keyed.select(F.col("doc_id"), F.col("_rid").alias("rid"), text.alias("text")), min_words)
    gone = freeze(gone.select(F.col("doc_id").alias("_gone_id"), F.col("rid").alias("_gone_rid"), F.col("gone").alias("_gone")))
    # merge: the same plan at every size, whatever the planner takes ``gone`` to be
    joined = keyed.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_gone_id")) & (F.col("_rid") == F.col("_gone_rid")), "left")
    return _without(joined, docs.columns)


def _without(joined: DataFrame, columns: list[str]) -> DataFrame:
    split = joined.withColumn("_lines", F.explode(F.array(F.split(F.col("text").cast("string"), "\n"))))
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col("_lines"), i)), "\n")
    out = [F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col(f"`{c}`") for c in columns if c not in ("n_lines", "removed_lines")]
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size("_lines")).cast("long")
    return split.select(*out, n.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("removed_lines"))
