"""Mixing sources to target weights, DataFrame functions only.

A source's words, document after document in a fixed order, are cut into blocks of BLOCK words, the last of which may be short.
Targets are given in words; a source gets as many slots as its target needs, and its last slot takes only the words that are
left to take, so a source's words come to its target, whole words. For every output shard of SHARD_SLOTS slots the counts of the
sources are drawn from a multinomial distribution; where the draws of all shards together give a source more slots than it
needs, its last ones go to the sources that got fewer. The k-th slot of a source takes its block perm(k mod n) in epoch k / n,
perm being a pseudorandom permutation of its n block numbers that is computed, not stored (swap-or-not rounds). Blocks are
joined by their number.

Nothing gathers a source in one place: offsets are sums over buckets of rows first and over rows inside a bucket then, with
about as many buckets as a bucket has rows, slots are drawn independently, and (source, block) keys have a few rows each. A
target is at most twice its source, so a block is taken twice at most. Everything follows from hashes of ids and texts and a
seed: reruns agree.

Defined results: null and blank texts have size 0 and are taken 0 times; a null source is a source of its own, the last; repeated
rows are mixed as documents of their own (``mix_documents``, which must join texts again, takes rows of equal id and text as
one); an empty table gives no rows; extra columns are left out (``mix_documents``: kept, whatever their names). A document taken in part keeps the white space inside its spans; spans
that are not neighbours are set apart by a line break.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, WORD, checkpointed, free_name, let, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD_SLOTS, ROUNDS, SEED = 1024, 1 << 14, 16, 42


def _before(order: list, *keys: str):
    """Rows before the current one."""
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def source_targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """A row for each source: (source, sid, source_size, weight, target), targets in words.

    Weights repeat in the order of the sources. ``share`` of all words is dealt by weight, but no source goes beyond
    ``most`` times its size; what it cannot take is dealt again among the others. Sorted by the level at which each source
    is full, the level that all others reach is that of the first source which does not fill up.
    """
    cycle = F.array(*(F.lit(float(w)) for w in weights))
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    per = per.withColumns({"weight": F.get(cycle, F.col("sid") % len(weights)), "room": most * F.col("source_size")})
    per = per.withColumn("full_at", F.col("room") / F.col("weight"))
    order = [F.col("full_at"), F.col("sid")]
    total = share * F.sum("source_size").over(Window.partitionBy().orderBy(*order).rowsBetween(*_ENDS))
    used = F.coalesce(F.sum("room").over(_before(order)), F.lit(0.0))
    open_weight = F.sum("weight").over(Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("level", (total - used) / open_weight)
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "sid", "level")))
    per = per.withColumn("reached", first.over(Window.partitionBy().orderBy(*order).rowsBetween(*_ENDS))["level"])
    target = F.least(F.col("room"), F.col("reached") * F.col("weight"))
    return per.select("source", "sid", "source_size", "weight", F.coalesce(target, F.col("room")).alias("target"))


_ENDS = (Window.unboundedPreceding, Window.unboundedFollowing)


def block_plan(targets: DataFrame) -> DataFrame:
    """``targets`` with the number of blocks and of slots of each source that has words, and the words that its last slot takes.

    Whole epochs come first. In the one that is taken in part, the short block stands at a slot that the permutation tells: up
    to there slots have BLOCK words each, after it BLOCK - short are lacking.
    """
    plan = targets.where("source_size > 0").withColumn("n_blocks", F.ceil(F.col("source_size") / BLOCK).cast("long"))
    plan = plan.withColumn("take", F.least(F.floor(F.col("target") + 1e-6).cast("long"), MOST * F.col("source_size")))
    plan = plan.withColumn("epochs", F.floor(F.try_divide("take", "source_size")).cast("long"))
    lacking = F.col("n_blocks") * BLOCK - F.col("source_size")
    short_at = permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("sid"), F.col("epochs"), inverse=True)
    plan = plan.withColumns({"rest": F.col("take") - F.col("epochs") * F.col("source_size"), "lacking": lacking, "short_at": short_at})
    behind = F.col("rest") > F.col("short_at") * BLOCK
    plan = plan.withColumn("reach", F.col("rest") + F.when(behind, F.col("lacking")).otherwise(0))
    more = F.ceil(F.col("reach") / BLOCK).cast("long")
    left = F.col("reach") - (more - 1) * BLOCK - F.when(more - 1 == F.col("short_at"), F.col("lacking")).otherwise(0)
    plan = plan.withColumns({"slots": F.col("epochs") * F.col("n_blocks") + more, "last_words": F.when(more > 0, left).otherwise(BLOCK)})
    return plan.drop("take", "epochs", "rest", "lacking", "short_at", "reach")


def placed(sized: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """``sized`` with its source's columns and ``start``: the words of the same source before the document."""
    buckets = max(1, math.isqrt(sized.count()))
    rows = sized.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys, "size"), F.lit(buckets)))
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(_before([F.col("bucket")], "sid")), F.lit(0)))
    order = [*(F.asc_nulls_first(k) for k in keys), F.col("size")]
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(_before(order, "sid", "bucket")), F.lit(0)))
    rows = rows.join(sums.select("sid", "bucket", "base"), ["sid", "bucket"])
    return rows.withColumn("start", F.col("base") + F.col("inner")).drop("bucket", "base", "inner")


def permuted(index: Column, n: Column, *salt: Column, rounds: int = ROUNDS, inverse: bool = False) -> Column:
    """``index`` under a pseudorandom permutation of 0 .. n - 1, or under its inverse.

    Each round pairs x with key - x (mod n) and swaps a pair or not by a hash of its larger member: its own inverse,
    so a permutation for any n, and the rounds in the other order give the inverse.
    """

    def turn(x: Column, r: Column) -> Column:
        key = F.pmod(F.xxhash64(F.lit(SEED), *salt, r), n)
        swap = lambda other: F.when(F.xxhash64(r, *salt, F.greatest(x, other)) % 2 == 0, other).otherwise(x)
        return let(F.pmod(key - x, n), swap)

    order = (rounds, 1) if inverse else (1, rounds)
    return F.aggregate(F.sequence(*map(F.lit, order)), index.cast("long"), turn)


def draw_slots(plan: DataFrame) -> DataFrame:
    """(shard, slot, sid, k): which source fills each output slot, and with how many of its own slots before."""
    spark = plan.sparkSession
    order = [F.col("sid")]
    plan = plan.withColumn("low", F.coalesce(F.sum("slots").over(_before(order)), F.lit(0)).cast("double"))
    plan = plan.withColumn("high", F.col("low") + F.col("slots"))
    size = plan.agg(F.sum("slots").alias("t"), F.count("*").alias("n")).first()
    total, sources = size["t"] or 0, size["n"]
    cells = max(4096, 4 * sources)
    width = max(total, 1) / cells
    # each source's share of the line 0 .. total, cut into cells, so that a draw finds it by an equi-join
    cell = lambda x: F.least(F.floor(x / width), F.lit(cells - 1)).cast("long")
    ranges = plan.where("slots > 0").select("sid", "low", "high", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col("slot")), 11) / F.lit(float(1 << 53))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / SHARD_SLOTS).alias("shard"))
    slots = slots.withColumn("u", unit * total).withColumn("cell", cell(F.col("u")))
    drawn = slots.join(ranges, "cell").where("low <= u AND u < high").select("shard", "slot", "sid")

    counts = drawn.groupBy("sid", "shard").agg(F.count("*").alias("n"))  # the multinomial counts of every shard
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(_before([F.col("shard")], "sid")), F.lit(0)))
    ranked = drawn.withColumn("i", F.row_number().over(Window.partitionBy("sid", "shard").orderBy("slot")) - 1)
    ranked = ranked.join(counts.select("sid", "shard", "base"), ["sid", "shard"]).withColumn("k", F.col("base") + F.col("i"))

    got = counts.groupBy("sid").agg(F.sum("n").alias("got"))
    fair = plan.select("sid", "slots").join(got, "sid", "left").na.fill(0, ["got"])
    over, under = F.greatest(F.col("got") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("got"), F.lit(0))
    fair = fair.withColumns({"over": over, "under": under})
    fair = fair.withColumns({c + "_before": F.coalesce(F.sum(c).over(_before(order)), F.lit(0)) for c in ("over", "under")})
    ranked = ranked.join(fair.select("sid", "slots", "over_before"), "sid")
    fill = fair.where("under > 0").select("sid", F.posexplode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("j", "k"), "under_before")
    fill = fill.select((F.col("under_before") + F.col("j")).alias("v"), "sid", "k")
    kept = ranked.where("k < slots").select("shard", "slot", "sid", "k")
    freed = ranked.where("k >= slots").select("shard", "slot", (F.col("over_before") + F.col("k") - F.col("slots")).alias("v"))
    return kept.unionByName(freed.join(fill, "v").select("shard", "slot", "sid", "k"))


def mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """(shard, slot, epoch, sid, start, first, n): the pieces of documents that fill each output slot.

    ``docs``: rows of ``placed``; a document is known by (sid, start), and gives its words first .. first + n - 1.
    """
    pieces = docs.where("size > 0").select("sid", "start", "size")
    pieces = pieces.withColumn("block", F.explode(F.sequence(F.expr(f"start DIV {BLOCK}"), F.expr(f"(start + size - 1) DIV {BLOCK}"))))
    low = F.greatest(F.col("block") * BLOCK - F.col("start"), F.lit(0))
    high = F.least((F.col("block") + 1) * BLOCK - F.col("start"), F.col("size"))
    inside = F.greatest(F.col("start") - F.col("block") * BLOCK, F.lit(0))
    pieces = pieces.select("sid", "start", "block", low.alias("first"), (high - low).alias("n"), inside.alias("inside"))
    slots = draw_slots(plan).join(plan.select("sid", "n_blocks", "slots", "last_words"), "sid").withColumn("epoch", F.expr("k DIV n_blocks"))
    slots = slots.withColumn("block", permuted(F.col("k") % F.col("n_blocks"), F.col("n_blocks"), F.col("sid"), F.col("epoch")))
    words = F.when(F.col("k") == F.col("slots") - 1, F.col("last_words")).otherwise(BLOCK)
    filled = slots.select("shard", "slot", "epoch", "sid", "block", words.alias("words")).join(pieces, ["sid", "block"])
    filled = filled.withColumn("n", F.least(F.col("n"), F.col("words") - F.col("inside"))).where("n > 0")
    return filled.select("shard", "slot", "epoch", "sid", "start", "first", "n")


def _sized(docs: DataFrame, hash_name: str = "_hash") -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    return checkpointed(docs.select("doc_id", "source", size.alias("size"), F.col(hash_name).alias("_hash")))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = _sized(docs.withColumn("_hash", F.xxhash64("text")))
    targets = checkpointed(source_targets(sized))
    docs = placed(sized, targets, ["doc_id", "_hash"])
    taken = mix(docs, block_plan(targets)).groupBy("sid", "start").agg(F.sum("n").alias("taken"))
    taken = taken.withColumn("some", F.lit(True))
    docs = docs.withColumn("some", F.col("size") > 0).join(taken, ["sid", "start", "some"], "left")
    return docs.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def _spans(text: Column, spans: Column) -> Column:
    """The words of a text in ``spans`` (first, n; in order) with the white space between them."""

    def cut(words: Column) -> Column:
        def add(done: Column, s: Column) -> Column:
            piece = F.array_join(F.slice(words, s["first"].cast("int") + 1, s["n"].cast("int")), "")
            apart = F.concat(F.regexp_replace(done["text"], SPACE + r"\z", ""), F.lit("\n"))
            before = F.when((done["end"] == s["first"]) | (done["end"] == 0), done["text"]).otherwise(apart)
            return F.struct(F.concat(before, piece).alias("text"), (s["first"] + s["n"]).alias("end"))

        begin = F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("end"))
        return F.regexp_replace(F.aggregate(spans, begin, add)["text"], SPACE + r"\z", "")

    return let(F.regexp_extract_all(text, F.lit(f"({WORD}{SPACE[:-1]}*)"), 1), cut)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The mixed corpus as documents: a row for each document and epoch that takes any of it, with the words taken."""
    hashed = free_name(docs, "_hash")
    keyed = docs.withColumn(hashed, F.xxhash64("text"))
    sized = _sized(keyed, hashed)
    if not sized.groupBy("doc_id", "_hash").count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", hashed])
        sized = checkpointed(sized.dropDuplicates(["doc_id", "_hash"]))
    targets = checkpointed(source_targets(sized))
    rows = placed(sized, targets, ["doc_id", "_hash"])
    parts = mix(rows, block_plan(targets)).groupBy("sid", "start", "epoch")
    parts = parts.agg(F.sum("n").alias("taken"), F.sort_array(F.collect_list(F.struct("first", "n"))).alias("spans"))
    own = rows.where("size > 0").select("sid", "start", "size", "doc_id", "_hash")
    named = {c: free_name(keyed, "_own_" + c.strip("_")) for c in ("doc_id", "_hash", "size", "taken", "spans")}
    parts = parts.join(own, ["sid", "start"]).select(*(F.col(c).alias(n) for c, n in named.items()))
    mine = {c: F.col(n) for c, n in named.items()}
    mixed = keyed.join(parts, F.col("doc_id").eqNullSafe(mine["doc_id"]) & (F.col(hashed) == mine["_hash"]))
    text = F.when(mine["taken"] < mine["size"], _spans(F.col("text"), mine["spans"])).otherwise(F.col("text"))
    mixed = mixed.withColumn("text", text)
    if "n_chars" in docs.columns:
        mixed = mixed.withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*docs.columns)
