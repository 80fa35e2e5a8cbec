r"""Quality rules and a log-likelihood ratio of hashed n-grams, in DataFrame functions only.

Words and bigrams of tokens (runs of letters and digits, runs of other marks; case kept) are hashed into a fixed number of buckets. Counts over all
documents give a raw multinomial, counts over trusted documents a target one (smoothed towards the raw one). A document's score is the mean over
its n-grams of the log ratio of the two, and a document is kept by it if the score reaches a fixed threshold.

Base rules count words (`[^\x20\x09-\x0D]+`), marks, repeated lines and words in repeated three-word windows; a document fails them with
under 50 words or with over half of its words in repeated windows.

The table of weights has as many rows as there are buckets, which bounds its broadcast. Counts are summed before any shuffle. All trusted documents
are counted: their ids are broadcast in hash blocks of bounded size, and each block counts the documents of its hashes, so a text is read once per block
and cut into tokens once.

Defined results: null and empty texts have no words, fail the base and score 0. Without trusted documents all weights are 0. Trusted ids match
``doc_id`` once each, null ids never; repeated rows are judged one by one. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import let, save_and_read, words

BUCKETS = 1 << 16
#: Pseudo-count of the raw multinomial in the target one.
PRIOR = 1 << 16
#: Least mean log ratio of a kept document.
THRESHOLD = -0.2
#: n-grams that a document's length is taken to have in addition, so that a few rare ones decide little.
EXTRA_GRAMS = 20
#: Trusted ids that meet the documents at once, about; more of them, and the documents with them, are cut by a hash of the id.
ID_BLOCK = 1 << 20
LEAST_WORDS, REPEAT_PERCENT = 50, 50
SYMBOLS = "#*$%&|<>"


def chars(text: Column, drop: str) -> Column:
    return F.length(F.translate(text, drop, ""))


def with_base(docs: DataFrame) -> DataFrame:
    r"""``row, doc_id, text`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    filled = F.filter(F.split("text", "\n"), lambda s: F.ltrim(s, F.lit(" \t\n\x0b\x0c\r")) != "")
    rows = rows.withColumns({"_words": words(F.col("text")), "_lines": filled})
    rows = rows.withColumn("n_words", F.size("_words").cast("long"))
    window = F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2]),
    )
    rows = rows.withColumn("_windows", F.when(F.col("n_words") >= 3, window).otherwise(F.array().cast("array<long>")))
    unique = F.size(F.array_distinct("_windows")) == F.size("_windows")
    rows = rows.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("text") - chars(F.col("text"), SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(unique, F.lit(0)).otherwise(repeat_words(F.col("_windows"))).cast("long"),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select("row", "doc_id", "text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def repeat_words(windows: Column) -> Column:
    """How many words lie in windows of three that occur twice or more, from the hashes of all windows in order."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum"))
    # each window adds the words that the window before it did not cover
    step = lambda s, x: F.struct(x.alias("last"), (s["sum"] + F.least(F.lit(3), x - s["last"])).alias("sum"))

    def covered(x):
        ordered = x["ordered"]
        same = lambda w, i: F.coalesce(F.get(ordered, i)["h"] == w["h"], F.lit(False))
        again = F.filter(ordered, lambda w, i: same(w, i - 1) | same(w, i + 1))
        return F.aggregate(F.sort_array(F.transform(again, lambda w: w["at"])), start, step, lambda s: s["sum"])

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    return let(covered, ordered=F.sort_array(pairs))


def tokens(text: Column) -> Column:
    return words(F.regexp_replace(F.coalesce(text, F.lit("")), r"([^\p{L}\p{N}\s]+)", " $1 "))


def with_buckets(df: DataFrame, n: int = BUCKETS) -> DataFrame:
    """A row for each token of ``_tokens``, one row at least: ``one`` is the token's bucket and ``two`` that of it and the next token, null where there is none.

    The hashes stand outside of array functions, where Spark compiles them.
    """
    of = lambda h: F.pmod(h, F.lit(n)).cast("int")
    at, size, token = F.col("_at"), F.size("_tokens"), lambda i: F.get("_tokens", i)
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1))
    return df.withColumn("_at", F.explode_outer(places)).withColumns(
        {
            "one": F.when(at.isNotNull(), of(F.xxhash64(token(at)))),
            "two": F.when(at + 1 < size, of(F.xxhash64(token(at), token(at + 1), F.lit(2)))),
        }
    ).drop("_at", "_tokens")


def weights(docs: DataFrame, trusted: DataFrame, n: int = BUCKETS, prior: float = PRIOR, id_block: int = ID_BLOCK) -> DataFrame:
    """``bucket, weight``: log of the smoothed target share of each bucket over its raw share, one row for each bucket that occurs."""
    ids = trusted.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("_trusted")).where("_trusted is not null").distinct()
    ids = save_and_read(ids, "ngram-trusted")  # read once per block
    blocks = -(-ids.count() // id_block) or 1
    inside = lambda c, block: F.pmod(F.xxhash64(c), F.lit(blocks)) == block if blocks > 1 else F.lit(True)
    found = None
    for block in range(blocks):
        own = ids.where(inside("_trusted", block))  # its size bounds the broadcast
        rows = docs.select("doc_id", "text").where(inside("doc_id", block))
        marked = rows.join(F.broadcast(own), rows["doc_id"] == own["_trusted"], "left")
        marked = marked.select(F.col("_trusted").isNotNull().cast("long").alias("t"), tokens(F.col("text")).alias("_tokens"))
        grams = with_buckets(marked, n).select("t", F.explode(F.array("one", "two")).alias("bucket")).where("bucket is not null")
        part = save_and_read(grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("t").alias("target")), "ngram-counts")
        found = part if found is None else found.unionByName(part)
    counts = found.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")) if blocks > 1 else found  # read three times below
    raw_all, target_all = (counts.agg(F.sum(c)).scalar() for c in ("raw", "target"))
    share = F.col("raw") / raw_all
    ratio = F.log((F.col("target") + prior * share) / (target_all + prior)) - F.log(share)
    return counts.select("bucket", F.when(target_all > 0, ratio).otherwise(0.0).alias("weight"))


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept`` for every row of ``docs``."""
    table = weights(docs, trusted)
    of = lambda name: F.broadcast(table.select(F.col("bucket").alias(name), F.col("weight").alias(f"weight_{name}")))
    base = with_base(docs)
    facts = [c for c in base.columns if c not in ("row", "text")]
    grams = with_buckets(base.select("row", *facts, tokens(F.col("text")).alias("_tokens")))
    weight = F.coalesce("weight_one", F.lit(0.0)) + F.coalesce("weight_two", F.lit(0.0))
    # A filter on a grouping column moves below the grouping, where the repeats would be worked out again inside it.
    late = ("n_repeat_words", "base_failed")
    scored = grams.join(of("one"), "one", "left").join(of("two"), "two", "left").groupBy("row", *(c for c in facts if c not in late)).agg(
        *(F.max(c).alias(c) for c in late), F.sum(weight).alias("sum"), (F.count("one") + F.count("two")).alias("grams")
    )
    score = F.coalesce(F.col("sum"), F.lit(0.0)) / (F.col("grams") + EXTRA_GRAMS)
    out = scored.withColumn("score", score)
    return out.select(*facts, "score", (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"))
