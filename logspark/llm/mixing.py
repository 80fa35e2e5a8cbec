"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. The words of each source and its weight give its target; a target stops at a multiple of the source's size and the excess is shared
   again by weight (solved at once from running sums over the sources in order of size per weight).
2. Every document is cut into blocks of words. A source is passed over as often as its target asks for; each pass orders its blocks by a seeded
   hash, and the last pass ends within the block that reaches the target. That gives each source an exact quota of blocks.
3. A binary tree divides the quotas among the output shards: at each node the blocks of all sources going left are a multivariate
   hypergeometric draw, made source by source. The leaves hold exact quotas per source and shard.
4. A shard takes its quota of consecutive blocks of each permuted source, so shards are disjoint, and orders them by another hash.

Blocks are ranked within hash ranges of bounded size plus running sums of the range totals, so a source with most of the rows is spread
over many tasks. Draws of standard deviation below 100 invert the exact distribution; larger ones round a normal variate, which
moves a quota by less than its own chance error; quotas add up exactly either way.

Defined results: a null or empty text has size 0 and nothing is taken of it. Rows without a source form one source, the last.
Repeated rows are separate documents. An empty table gives an empty result. Equal input gives equal output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import count_words, let, save_and_read

WEIGHTS = (1, 2, 3)
#: Times a source's size that its target may reach.
CAP = 3
BLOCK_WORDS = 512
SHARDS = 16
SEED = 7
#: Blocks ranked together in one task, about.
RANGE = 4096
EXACT_SPREAD = 100.0


def uniform(*parts) -> Column:
    """A number above 0 and below 1 that depends on ``parts`` alone."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def sizes(docs: DataFrame) -> DataFrame:
    """``row, doc_id, source, size`` of every document."""
    out = docs.select("doc_id", "source", count_words(F.col("text")).cast("long").alias("size"))
    return save_and_read(out.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source, source_size, target``: sources by code point, null last, weigh ``weights`` in turn. A row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    most = (F.col("source_size") * cap).cast("double")
    rows = totals.withColumn("weight", weight).withColumns({"most": most, "ratio": most / F.col("weight")})
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    rows = rows.withColumns({"level": left / F.sum("weight").over(after), "place": F.row_number().over(order)})
    level = F.min_by(F.when(F.col("ratio") > F.col("level"), F.col("level")), F.when(F.col("ratio") > F.col("level"), F.col("place"))).over(every)
    target = F.when(level.isNull(), F.col("most")).otherwise(F.least("most", level * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"))


def same(left: DataFrame, right: DataFrame, key: str = "source") -> Column:
    return left[key].eqNullSafe(right[key])


def drawn(sized: DataFrame, goals: DataFrame, block_words: int, seed: int) -> DataFrame:
    """``row, doc_id, source, size, block, pass, rank, taken``: the blocks that the mix takes, ranked in their source."""
    goal = goals.select("source", F.col("source_size").alias("_size"), F.rint("target").cast("long").alias("_goal")).where("_size > 0")
    rows = sized.where("size > 0").join(goal, same(sized, goal), "inner").drop(goal["source"])
    rows = rows.withColumns({"_full": F.floor(F.col("_goal") / F.col("_size")), "_rest": F.col("_goal") % F.col("_size")})
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - F.when(F.col("_rest") > 0, 0).otherwise(1))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))))
    rows = rows.withColumn("words", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
    rows = rows.withColumn("key", F.xxhash64(F.lit(seed), "pass", "doc_id", "block"))
    blocks = sized.agg(F.sum(F.ceil(F.col("size") / block_words))).first()[0] or 0
    ranges = max(1, math.ceil(int(blocks) / RANGE))
    rows = rows.withColumn("range", F.pmod("key", F.lit(ranges)))

    group = ["source", "pass", "range"]
    per_range = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum("words").alias("w"), F.max("_size").alias("s"))
    ahead = Window.partitionBy("source", "pass").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.select(
        F.col("source").alias("_source"), F.col("pass").alias("_pass"), F.col("range").alias("_range"),
        *(F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_before") for c in ("n", "w")),
        F.sum("n").over(Window.partitionBy("source", "pass")).alias("per_pass"),
    )
    inside = Window.partitionBy(*group).orderBy("key", "doc_id", "block", "size", "row")
    ranked = rows.withColumns({"_n": F.row_number().over(inside), "_w": F.sum("words").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    at = ranked["source"].eqNullSafe(starts["_source"]) & (ranked["pass"] == starts["_pass"]) & (ranked["range"] == starts["_range"])
    ranked = ranked.join(starts, at)
    before = F.col("w_before") + F.col("_w") - F.col("words")
    taken = F.when(F.col("pass") < F.col("_full"), F.col("words")).otherwise(F.least("words", F.col("_rest") - before))
    rank = F.col("pass") * F.col("per_pass") + F.col("n_before") + F.col("_n") - 1
    out = ranked.withColumns({"taken": taken, "rank": rank}).where("taken > 0")
    return out.select("row", "doc_id", "source", "size", "block", "pass", "rank", "taken")


def hypergeometric(population: Column, marked: Column, picked: Column, u: Column, v: Column) -> Column:
    """How many of ``picked`` out of ``population`` are ``marked``, from the uniform numbers ``u`` and ``v``."""
    population, marked, picked = (c.cast("double") for c in (population, marked, picked))
    return let(_bounded, all=population, marked=marked, picked=picked, u=u, v=v)


def _bounded(x: Column) -> Column:
    mean = x["picked"] * x["marked"] / F.greatest(x["all"], F.lit(1.0))
    square = mean * (x["all"] - x["marked"]) * (x["all"] - x["picked"]) / F.greatest(x["all"] * (x["all"] - 1), F.lit(1.0))
    low, high = F.greatest(F.lit(0.0), x["picked"] + x["marked"] - x["all"]), F.least(x["picked"], x["marked"])
    mode = F.least(high, F.greatest(low, F.floor((x["picked"] + 1) * (x["marked"] + 1) / (x["all"] + 2)).cast("double")))

    def choose(y):
        normal = F.rint(y["mean"] + y["spread"] * F.sqrt(-2 * F.log(x["u"])) * F.cos(2 * math.pi * x["v"]))
        draw = F.when(y["spread"] > EXACT_SPREAD, normal).otherwise(_inverted(x, y))
        return F.least(y["high"], F.greatest(y["low"], draw)).cast("long")

    return let(choose, mean=mean, spread=F.sqrt(F.greatest(square, F.lit(0.0))), low=low, high=high, mode=mode)


def _inverted(x: Column, y: Column) -> Column:
    """The outcome at which the sum of chances reaches ``u``; outcomes in the order mode, mode + 1, ..., then mode - 1, mode - 2, ..."""
    reach = F.ceil(12 * y["spread"]) + 12

    def draw(z):
        offset = lambda i: F.when(i <= z["up"], i).otherwise(z["up"] - i)
        steps = F.sequence(F.lit(0), z["up"] + z["down"])

        def chance(state, i):
            k = y["mode"] + offset(i)
            others = x["all"] - x["marked"] - x["picked"] + k
            rise = state["p"] * (x["marked"] - k + 1) * (x["picked"] - k + 1) / (k * others)
            fall = F.when(i == z["up"] + 1, F.lit(1.0)).otherwise(state["p"]) * (k + 1) * (others + 1) / ((x["marked"] - k) * (x["picked"] - k))
            return F.when(i == 0, F.lit(1.0)).when(i <= z["up"], rise).otherwise(fall)

        def add(state, i):
            return let(lambda c: F.struct(c["p"].alias("p"), (state["sum"] + c["p"]).alias("sum")), p=chance(state, i))

        total = F.aggregate(steps, F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum")), add, lambda s: s["sum"])

        def find(t):
            def walk(state, i):
                def step(c):
                    sum_ = state["sum"] + c["p"]
                    at = F.when((state["at"] < 0) & (sum_ >= t["goal"]), i).otherwise(state["at"])
                    return F.struct(c["p"].alias("p"), sum_.alias("sum"), at.alias("at"))

                return let(step, p=chance(state, i))

            begin = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("sum"), F.lit(-1).alias("at"))
            return F.aggregate(steps, begin, walk, lambda s: y["mode"] + F.when(s["at"] < 0, F.lit(0)).otherwise(offset(s["at"])))

        return let(find, goal=x["u"] * total)

    up, down = F.least(y["high"] - y["mode"], reach).cast("int"), F.least(y["mode"] - y["low"], reach).cast("int")
    return let(draw, up=up, down=down)


def shard_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``source, ends``: for each source the rank at which each shard's blocks end. ``quotas`` has ``source, quota``; a row per source."""
    order = F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota")))
    nodes = quotas.agg(order.alias("s")).select(F.col("s.source").alias("sources"), F.col("s.quota").alias("q"), F.lit(0).alias("node"))
    width, level = shards, 0
    while width > 1:
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x)
        start = F.struct(
            F.array().cast("array<long>").alias("left"), F.floor(total * (width // 2) / width).alias("pick"), total.alias("all")
        )


        def draw(s, x):
            i = F.size(s["left"])
            u, v = (uniform(F.lit(seed), F.col("level"), F.col("node"), i, F.lit(k)) for k in (0, 1))
            mine = hypergeometric(s["all"], x, s["pick"], u, v)
            return let(
                lambda m: F.struct(
                    F.array_append(s["left"], m["n"]).alias("left"), (s["pick"] - m["n"]).alias("pick"), (s["all"] - x).alias("all")
                ),
                n=mine,
            )

        split = nodes.withColumn("level", F.lit(level)).withColumn("left", F.aggregate("q", start, draw, lambda s: s["left"]))
        right = F.zip_with("q", "left", lambda a, b: a - b)
        halves = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")), F.struct((F.col("node") * 2 + 1).alias("node"), right.alias("q")))
        nodes = save_and_read(split.select("sources", F.explode(halves).alias("h")).select("sources", "h.node", "h.q"), f"mix-level{level}")
        width, level = width // 2, level + 1
    leaves = nodes.select("node", F.explode(F.arrays_zip("sources", "q")).alias("z")).select("node", F.col("z.sources").alias("source"), F.col("z.q").alias("q"))
    ends = F.sum("q").over(Window.partitionBy("source").orderBy("node"))
    return leaves.withColumn("end", ends).groupBy("source").agg(F.sort_array(F.collect_list("end")).alias("ends"))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (``row, doc_id, source, size``), targets (``source, source_size, target``) and the mix itself.

    The mix has a row per block taken: ``row, doc_id, source, block, pass, shard, place, taken``; a shard is read in order of ``place``,
    and block ``b`` is the ``taken`` words of its text from word ``b * block_words`` on. ``shards`` is a power of two.
    """
    sized = sizes(docs)
    goals = save_and_read(targets(sized, weights, cap), "mix-targets")
    blocks = save_and_read(drawn(sized, goals, block_words, seed), "mix-blocks")
    ends = shard_quotas(blocks.groupBy("source").agg(F.count("*").alias("quota")), shards, seed)
    placed = blocks.join(ends, same(blocks, ends)).drop(ends["source"])
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    place = F.xxhash64(F.lit(seed + 1), "source", "rank")
    return sized, goals, placed.select("row", "doc_id", "source", "block", "pass", shard.alias("shard"), place.alias("place"), "taken")


def taken_words(sized: DataFrame, goals: DataFrame, taken: DataFrame) -> DataFrame:
    """``row, doc_id, size, source_size, target, taken, shards`` of every document."""
    per_row = taken.groupBy("row").agg(F.sum("taken").alias("taken"), F.count_distinct("shard").alias("shards"))
    rows = sized.join(per_row, "row", "left").join(goals, same(sized, goals), "left").drop(goals["source"])
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.select("row", "doc_id", "source", "size", "source_size", "target", zero("taken"), zero("shards"))
