"""Mixing sources to target weights on a low-discrepancy schedule, in
DataFrame functions only.

The mix is a sequence of slots of ``block`` words. A golden-ratio lattice puts
slot i at a point of the unit interval, and the cumulative target shares of
the sources say whose slot it is, so that every stretch of the mix has each
source near its share. The r-th slot of a source takes the r-th block of the
source's documents in shuffled order, from the front again once all blocks are
used. Documents are joined to the blocks that they lie in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesledger.llm.common import freeze, n_words, rank_within, running_total

WEIGHTS = (3, 1, 2)
EPOCHS = 2
#: Words in the mix for each word in the sources, as a fraction.
TOTAL = (3, 2)
BLOCKS_PER_DOCUMENT = 8
#: The lattice: points i * STEP mod GRID, STEP / GRID near the golden ratio.
GRID_BITS = 31
GRID = 1 << GRID_BITS
STEP = 1327217885
BIG = "decimal(38,0)"
SOURCE = ["nosource", "src"]
MADE = ["size", "source_size", "target", "taken", "first_slot"]


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source (nosource, src): total, weight, target (double) and
    want (the target as whole words).

    Sources by code point, null last, weigh 3, 1, 2, repeating. A source at
    its limit of two times its size leaves the excess to the others by weight:
    in the order of limit per weight, a source is at its limit if its share of
    what those before it have left reaches it. The running sums are over one
    row per source, not over documents.
    """
    per = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("total"))
    by_name = Window.orderBy(*SOURCE)
    weight = F.get(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(by_name) - 1) % len(WEIGHTS))
    weighed = per.select(*SOURCE, "total", weight.cast(BIG).alias("weight"), (F.col("total") * EPOCHS).cast(BIG).alias("limit"))
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.sum(F.col("total").cast(BIG)).over(whole)
    before = Window.orderBy(F.col("limit").cast("double") / F.col("weight").cast("double"), *SOURCE).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(BIG)
    up, down = TOTAL
    rest = weighed.select(
        "*",
        (all_words * up - F.coalesce(F.sum("limit").over(before), zero) * down).alias("left"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)).alias("weights"),
    )
    full = F.col("limit").cast("double") * down * F.col("weights").cast("double") <= F.col("weight").cast("double") * F.col("left").cast("double")
    marked = rest.withColumn("full", full)
    of = lambda column, at: F.sum(F.when(at, F.col(column)).otherwise(zero)).over(whole)
    left = all_words * up - of("limit", F.col("full")) * down
    share = F.try_divide(left.cast("double") * F.col("weight").cast("double"), down * of("weight", ~F.col("full")).cast("double"))
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(share)
    return marked.select(*SOURCE, "total", F.col("weight").cast("int").alias("weight"), target.alias("target")).withColumn("want", F.floor(F.col("target") + 0.5).cast("long"))


def schedule(targets: DataFrame, block: int) -> DataFrame:
    """The slots of the mix: slot (null for the few that even out a source's
    count at the end), source, rank, pass, block and the words it takes."""
    spark = targets.sparkSession
    blocks = F.ceil(F.col("total") / F.lit(block)).cast("long")
    passes = F.expr("want div total")
    need = passes * blocks + F.ceil((F.col("want") - passes * F.col("total")) / F.lit(block)).cast("long")
    wanted = targets.where("want > 0").select(*SOURCE, "total", "want", blocks.alias("blocks"), need.alias("need"))
    upto = Window.orderBy(*SOURCE).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edge = lambda x: F.floor(x.cast("double") / F.sum("need").over(whole).cast("double") * GRID).cast("long")
    spans = freeze(wanted.select("*", edge(F.sum("need").over(upto) - F.col("need")).alias("lo"), edge(F.sum("need").over(upto)).alias("hi")))
    count, slots = spans.agg(F.count(F.lit(1)), F.sum("need")).first()
    slots = slots or 0
    cell_bits = min(24, max(8, (4 * count).bit_length()))
    cells = spans.where("hi > lo").withColumn("cell", F.explode(F.expr(f"sequence(shiftright(lo, {GRID_BITS - cell_bits}), shiftright(hi - 1, {GRID_BITS - cell_bits}))")))
    point = (F.col("slot") % GRID * STEP) % GRID
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("x", point).withColumn("cell", F.shiftright("x", GRID_BITS - cell_bits))
    held = points.join(cells.select(*SOURCE, "cell", "lo", "hi"), "cell").where("x >= lo and x < hi")
    dealt = freeze(held.select("slot", *SOURCE, F.expr(f"slot div {slots // 4096 + 1}").alias("stretch")))
    ranked = rank_within(dealt, SOURCE, ["slot"], "stretch", "rank").drop("stretch")
    have = dealt.groupBy(*SOURCE).agg(F.count(F.lit(1)).alias("have"))
    short = spans.join(have, SOURCE, "left").withColumn("have", F.coalesce("have", F.lit(0).cast("long"))).where("have < need")
    tail = short.select(F.lit(None).cast("long").alias("slot"), *SOURCE, F.explode(F.expr("sequence(have, need - 1)")).alias("rank"))
    used = ranked.unionByName(tail).join(spans.select(*SOURCE, "total", "want", "blocks", "need"), SOURCE).where("rank < need")
    at = used.withColumn("pass", F.expr("rank div blocks")).withColumn("block", F.expr("rank % blocks"))
    size = F.least(F.lit(block), F.col("total") - F.col("block") * block)
    done = F.col("pass") * F.col("total") + F.col("block") * block
    return at.select("slot", *SOURCE, "rank", "pass", "block", F.least(size, F.col("want") - done).cast("long").alias("words"))


def mix(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """Columns ``carry`` of ``docs`` (doc_id, text, source, any others; all by
    default) with size, source_size, target, taken, first_slot; columns of these
    names are replaced.

    size: words of the text (null or empty: 0, never taken). taken: words that
    the mix takes from the row, repeats counted, at most two times size.
    first_slot: the first slot of the mix that holds words of the row, null for
    rows that are not taken, or only in the last blocks that even out a source's
    count. Ordered by it, every stretch of the mix has each source near its share. The
    shuffle orders a source's documents by md5 of doc_id, so reruns agree; rows
    that repeat a doc_id are documents of their own, in order of size. A null
    source is a source of its own; null doc_ids hash as an empty string. An
    empty table, or one without words, takes nothing.
    """
    carry = [c for c in carry or docs.columns if c not in MADE]
    mark = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = freeze(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in carry)).alias("own"), F.monotonically_increasing_id().alias("row"), F.col("source").isNull().cast("int").alias("nosource"),
            F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"), n_words(F.col("text").cast("string")).alias("size"), mark.alias("mark"), F.conv(F.substring(mark, 1, 3), 16, 10).cast("int").alias("part"),
        )
    )
    targets = freeze(source_targets(rows))
    words, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    block = max(1, -(-(words or 0) // (BLOCKS_PER_DOCUMENT * max(1, n))))
    in_pass = lambda k: F.sum(F.when(F.col("pass") == k, F.col("words")).otherwise(0))
    slot_in = lambda k: F.min(F.when((F.col("pass") == k) & (F.col("words") > 0), F.col("slot")))
    used = schedule(targets, block).groupBy(*SOURCE, "block").agg(in_pass(0).alias("u0"), in_pass(1).alias("u1"), slot_in(0).alias("s0"), slot_in(1).alias("s1"))
    placed = running_total(rows.where("size > 0").select("row", *SOURCE, "size", "mark", "part"), SOURCE, ["mark", "size", "row"], "part", "size", "start")
    pieces = placed.select("row", *SOURCE, "size", "start", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block"))

    def overlap(words: str) -> Column:
        first = F.greatest("start", F.col("block") * block)
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("start") + F.col("size"), F.col("block") * block + F.col(words)) - first)

    first = F.least(*(F.when(overlap(u) > 0, F.col(s)) for u, s in (("u0", "s0"), ("u1", "s1"))))
    taken = pieces.join(used, [*SOURCE, "block"]).groupBy("row").agg(F.sum(overlap("u0") + overlap("u1")).alias("taken"), F.min(first).alias("first_slot"))
    per_source = targets.select(*SOURCE, F.col("total").alias("source_size"), "target")
    out = rows.select("own", "row", *SOURCE, "size").join(taken, "row", "left").join(per_source, SOURCE)
    return out.select(*(F.col(f"own.`{c}`") for c in carry), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
