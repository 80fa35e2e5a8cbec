"""Keyword rules held in a table of any size, found in one pass over the texts.

A rule table has ``rule_id`` (unique), ``priority, keyword, label, severity, confidence``. Keywords are compared in lower case, hold any number of words, and may
run over line ends (lines of a source count as joined by single spaces). An empty or null keyword matches every text.

Two bit filters of bounded size, made by the executors, go to all tasks: one of the keywords' beginnings (as many bytes as the greatest power of two that the
keyword holds) and one of whole keywords. Rolling hashes of a text pass the filters, and what passes is cut out of the text and joined with the distinct
keywords, so only equal strings count. The texts are read once, whatever the number of rules, and no keyword reaches the driver. Rules
that share a keyword meet a text once, with the best of them.

Lines are read where they lie. As long as a task's next line follows the last one (same source, next number), the search goes on over the line end.
Where such a run of lines ends, only its first and last characters (as many as the longest keyword over a space could need) go on: they meet the
neighbouring runs by line number. Lines in file order thus send next to nothing, and lines in any order still give every match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from logspark.functions.rules import NEXT_STEPS, RULE_MODEL, SEVERITIES, SEVERITY_SCORES
from logspark.functions.substrings import KeywordFilter, bit_blocks, slots
from logspark.operators.ordering import first_rows
from logspark.session import save_and_read, ship

#: Keyword characters that each filter has room for at most, at 32 bits a character; more keywords than that let more false candidates pass on to the join.
BLOCK_CHARS = 8_000_000
#: Lines whose line ends one task looks at.
LINES = 4096


def _lowered(rules: DataFrame) -> DataFrame:
    return rules.withColumns({"keyword": F.lower(F.coalesce("keyword", F.lit(""))), "rule_id": F.col("rule_id").cast("long"), "priority": F.col("priority").cast("long")})


def _keyword_filter(keywords: DataFrame, block_chars: int) -> tuple[KeywordFilter | None, int]:
    """The filters of the distinct ``keywords``, and how far a keyword reaches over a line end; none without keywords."""
    size = F.octet_length("keyword")
    filled = keywords.where("keyword <> ''")
    rows = filled.groupBy(size.alias("size")).agg(F.count("*").alias("n"), F.max(F.when(F.contains("keyword", F.lit(" ")), F.char_length("keyword") - 1)).alias("reach")).collect()
    if not rows:
        return None, 0
    bits = slots(sum(r["n"] for r in rows), block_chars * 32)

    def mark(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            blocks, at = bit_blocks(batch.column(0), bits)
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(at, pa.int64())], names=["block", "at"])

    ship(keywords.sparkSession)
    marked = filled.select("keyword").mapInArrow(mark, "block long, at long")
    packed = marked.groupBy("block").applyInArrow(_pack, "block long, bits binary").collect()
    reach = max((r["reach"] for r in rows if r["reach"] is not None), default=0)
    return KeywordFilter(sorted(r["size"] for r in rows), bits, [(r["block"], bytes(r["bits"])) for r in packed]), reach


def _pack(table: pa.Table) -> pa.Table:
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([KeywordFilter.packed(table.column("at").to_numpy())], pa.binary())})


class _Run:
    """Consecutive lines of one source: the first and last characters of their joined text."""

    def __init__(self, source, line_no: int, reach: int):
        self.source, self.first, self.last, self.reach = source, line_no, line_no - 1, reach
        self.head, self.tail, self.size = "", "", 0

    def add(self, lines: list[str]) -> str:
        """The text in which the keywords that end in ``lines`` lie."""
        text = " ".join(lines)
        if self.last >= self.first:
            text = " " + text
        if self.size < self.reach:
            self.head = (self.head + text[: self.reach])[: self.reach]
        self.size += len(text)
        self.last += len(lines)
        joined = self.tail + text
        self.tail = joined[max(len(joined) - self.reach, 0) :]
        return joined

    def end(self) -> tuple:
        return self.source, None, self.first, self.last, self.head, self.tail


def _lined(lines: DataFrame, sent, reach: int) -> DataFrame:
    """``source_id, keyword`` of the candidates inside runs of lines, and rows without keyword for the runs' ends, one or more for each source."""
    kind = lines.schema["source_id"].dataType
    schema = StructType(
        [StructField("source_id", kind), StructField("keyword", StringType()), StructField("first", LongType()), StructField("last", LongType())]
        + [StructField(c, StringType()) for c in ("head", "tail")]
    )
    target = to_arrow_schema(schema)

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(dict(zip(target.names, map(list, zip(*rows, strict=True)), strict=True)), schema=target)

    def walk(batches):
        run = None
        for batch in batches:
            sources, numbers, texts = (c.to_pylist() for c in batch.columns)
            rows, owners, joined, at = [], [], [], 0
            while at < len(numbers):
                stop = at + 1
                while stop < len(numbers) and numbers[stop] == numbers[stop - 1] + 1 and sources[stop] == sources[at]:
                    stop += 1
                if run is None or run.source != sources[at] or run.last + 1 != numbers[at]:
                    if run is not None:
                        rows.append(run.end())
                    run = _Run(sources[at], numbers[at], reach)
                owners.append(run.source)
                joined.append(run.add(texts[at:stop]))
                at = stop
            if sent:
                found = dict.fromkeys((owners[k], keyword) for k, keyword in sent.value.found(pa.array(joined, pa.large_string())))
                rows += [(source, keyword, None, None, None, None) for source, keyword in found]
            if rows:
                yield out(rows)
        if run is not None:
            yield out([run.end()])

    ship(lines.sparkSession)
    ready = lines.select("source_id", F.col("line_no").cast("long"), F.lower(F.coalesce("line", F.lit(""))).alias("line"))
    return ready.mapInArrow(walk, schema)


def _over_ends(ends: DataFrame, sent, reach: int) -> DataFrame:
    """``source_id, keyword`` of candidates that run from one run of lines into later ones.

    Runs meet in blocks of line numbers. A run goes to the block it begins in and to those where the lines that it can reach begin: each line
    between holds a character at least, so a keyword of ``reach + 1`` characters ends within ``reach`` lines.
    """
    kind = ends.schema["source_id"].dataType
    schema = StructType([StructField("source_id", kind), StructField("keyword", StringType())])
    target = to_arrow_schema(schema)
    size = max(LINES, 2 * reach)
    at = lambda c: F.floor(c / size)
    blocks = F.array_distinct(F.array(at(F.col("first")), at(F.col("last") + 1), at(F.col("last") + reach)))
    spread = ends.withColumn("block", F.explode(blocks))

    def meet(batches):
        key, last, before = None, None, ""
        for batch in batches:
            owners, joined = [], []
            for r in batch.to_pylist():
                follows = key == (r["source_id"], r["block"]) and last is not None and r["first"] == last + 1
                if follows:
                    owners.append(r["source_id"])
                    joined.append(before + " " + r["head"])
                whole = len(r["head"]) < reach
                before = (before + " " + r["head"] if follows and whole else r["tail"])[-reach:]
                key, last = (r["source_id"], r["block"]), r["last"]
            if joined:
                rows = list(dict.fromkeys((owners[k], keyword) for k, keyword in sent.value.found(pa.array(joined, pa.large_string()))))
                yield pa.RecordBatch.from_pydict({"source_id": [s for s, _ in rows], "keyword": [w for _, w in rows]}, schema=target)

    ordered = spread.select("source_id", "block", "first", "last", "head", "tail").repartition("source_id", "block").sortWithinPartitions("source_id", "block", "first")
    return ordered.mapInArrow(meet, schema)


def _line_keywords(lines: DataFrame, keywords: DataFrame, block_chars: int) -> tuple[DataFrame, DataFrame]:
    """``source_id, keyword`` of the candidates, some of them more than once, and every ``source_id`` of ``lines``."""
    finder, reach = _keyword_filter(keywords, block_chars)
    sent = finder and lines.sparkSession.sparkContext.broadcast(finder)
    both = save_and_read(_lined(lines, sent, reach), "rule-hits")
    found, ends = both.where("keyword is not null").select("source_id", "keyword"), both.where("keyword is null")
    if reach:
        found = found.unionByName(_over_ends(ends, sent, reach))
    return found, ends.select("source_id").distinct()


def line_hits(lines: DataFrame, rules: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``source_id, rule_id``: the rules whose keyword the joined lines of a source contain, each once.

    ``lines`` holds ``source_id, line_no, line``, with numbers that follow each other. Null lines are empty ones; a missing number is a break that no keyword
    runs over; a source without lines has no hits.
    """
    named = save_and_read(_lowered(rules).select("keyword", "rule_id").distinct(), "rule-keywords")
    found, sources = _line_keywords(lines, named.select("keyword").distinct(), block_chars)
    hits = found.join(named, "keyword").select("source_id", "rule_id")
    always = named.where("keyword = ''").select("rule_id")  # a table's defaults
    return hits.unionByName(sources.crossJoin(always)).distinct()


def table_signals(lines: DataFrame, rules: DataFrame, limit: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``source_id, signals``: labels of the rules found in each source's joined lines, without repeats, in order of priority and id."""
    places = _lowered(rules).groupBy("keyword", "label").agg(F.min(F.struct("priority", "rule_id")).alias("place"))
    # A label that a source takes is among the first of the keyword that gives it its place.
    named = save_and_read(first_rows(places, ["keyword"], [F.asc("place")], limit).drop("rank"), "rule-labels")
    found, sources = _line_keywords(lines, named.select("keyword").distinct(), block_chars)
    sources = save_and_read(sources, "rule-sources")  # read twice
    always = named.where("keyword = ''").select("label", "place")
    hits = found.join(named, "keyword").select("source_id", "label", "place").unionByName(sources.crossJoin(always))
    labels = hits.groupBy("source_id", "label").agg(F.min("place").alias("place"))
    first = first_rows(labels, ["source_id"], [F.asc("place")], limit)
    listed = first.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("rank", "label"))).alias("s"))
    return sources.join(listed, "source_id", "left").select("source_id", F.coalesce(F.col("s.label"), F.array().cast("array<string>")).alias("signals"))


def _first(df: DataFrame, text: Column, rules: DataFrame, block_chars: int) -> DataFrame:
    """``df`` with ``_rule``: a struct of the columns of the rule of least priority, then id, whose keyword ``text`` contains, or null."""
    rest = [c for c in rules.columns if c not in ("priority", "rule_id")]
    rule = F.struct("priority", "rule_id", *rest)
    best = _lowered(rules).groupBy(F.col("keyword").alias("_keyword")).agg(F.min(rule).alias("_rule"))
    keywords = save_and_read(best, "rule-keywords")
    finder, _ = _keyword_filter(keywords.select(F.col("_keyword").alias("keyword")), block_chars)
    sent = finder and df.sparkSession.sparkContext.broadcast(finder)

    def find(texts: pa.Array) -> pa.Array:
        rows: list[dict] = [{} for _ in range(len(texts))]
        for k, keyword in sent.value.found(texts) if sent else ():
            rows[k][keyword] = None
        return pa.array([list(r) for r in rows], pa.list_(pa.string()))

    ship(df.sparkSession)
    found = F.arrow_udf(find, ArrayType(StringType()))(F.lower(F.coalesce(text, F.lit(""))))
    rows = save_and_read(df.withColumn("_found", found).withColumn("_row", F.monotonically_increasing_id()), "rule-rows")
    hits = rows.select("_row", F.explode("_found").alias("_keyword")).join(keywords, "_keyword")
    own = hits.groupBy("_row").agg(F.min("_rule").alias("_own"))
    default = keywords.where("_keyword = ''").select(F.col("_rule").alias("_default"))  # one row at most
    out = rows.drop("_found").join(own, "_row", "left").join(F.broadcast(default), F.lit(True), "left")
    return out.select(*df.columns, F.least("_own", "_default").alias("_rule"))


def first_rule(df: DataFrame, text: Column, rules: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``rule_id``: the rule of least priority, then id, whose keyword ``text`` contains, or null."""
    found = _first(df, text, rules.select("priority", "rule_id", "keyword"), block_chars)
    return found.select(*(c for c in df.columns if c != "rule_id"), "_rule.rule_id")


def _named(df: DataFrame, text: Column, rules: DataFrame, block_chars: int) -> DataFrame:
    found = _first(df, text, rules.select("priority", "rule_id", "keyword", "label", "severity", "confidence"), block_chars)
    own = [c for c in df.columns if c not in ("rule_id", "label", "severity", "confidence")]
    return found.select(*own, "_rule.rule_id", F.col("_rule.keyword").alias("_keyword"), "_rule.label", "_rule.severity", "_rule.confidence")


def table_severity(df: DataFrame, text: Column, rules: DataFrame, profile: str = "library", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``severity, confidence, scores`` of the first rule that matches ``text``; nulls where none does."""
    found = _named(df, text, rules, block_chars)
    if profile == "library":
        fixed = F.create_map(*(F.lit(x) for s, row in SEVERITY_SCORES.items() for x in (s, "|".join(map(str, row)))))
        scores = F.transform(F.split(F.element_at(fixed, F.col("severity")), r"\|"), lambda x: x.cast("double"))
    else:
        scores = F.array(*(F.when(F.col("severity") == s, F.col("confidence")).otherwise(F.lit(0.1)) for s in SEVERITIES))
    table = F.when(F.col("severity").isNotNull(), F.map_from_arrays(F.array(*map(F.lit, SEVERITIES)), scores))
    return found.select(*(F.col(c) for c in df.columns), "severity", "confidence", table.alias("scores"))


def table_cause(df: DataFrame, text: Column, rules: DataFrame, profile: str = "library", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``df`` with ``root_cause, severity, confidence, next_steps, model_used`` of the first rule that matches ``text``; nulls where none does."""
    found = _named(df, text, rules, block_chars)
    default = F.col("_keyword") == ""
    hit, other = (F.array(*map(F.lit, steps)) for steps in NEXT_STEPS[profile])
    steps = F.when(F.col("rule_id").isNotNull(), F.when(default, other).otherwise(hit))
    model = F.when(F.col("rule_id").isNotNull(), F.when(default, RULE_MODEL[profile][1]).otherwise(RULE_MODEL[profile][0]))
    return found.select(*(F.col(c) for c in df.columns), F.col("label").alias("root_cause"), "severity", "confidence", steps.alias("next_steps"), model.alias("model_used"))
