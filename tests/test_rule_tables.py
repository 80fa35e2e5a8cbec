"""Rule tables: plain search over joined texts, in any order of lines and with keywords of any length."""

import random

import pytest
from pyspark.sql import functions as F

from logspark.functions.rules import SIGNALS, Rule
from logspark.operators import explain, rule_tables

RULES = "rule_id long, priority long, keyword string, label string, severity string, confidence double"
WORDS = "out of memory disk full a an error ok x".split()


def made_up(seed, sources=6):
    rng = random.Random(seed)
    lines = {s: [" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 1, 2, 3, 9]))) for _ in range(rng.randint(1, 60))] for s in range(sources)}
    rules = [(k, rng.randint(0, 5), " ".join(rng.choice(WORDS) for _ in range(rng.choice([1, 2, 3, 4, 5, 8]))).title(), f"L{k % 9}", "HIGH", 0.5) for k in range(300)]
    return lines, [*rules, (900, 3, "of memory disk", "same", "INFO", 0.1), (901, 3, "Of Memory disk", "same", "INFO", 0.1), (902, 9, "never there", "no", None, None)]


def rows_of(lines):
    return [(s, k, line) for s, own in lines.items() for k, line in enumerate(own)]


@pytest.mark.parametrize("seed", range(3))
def test_hits_over_line_ends(spark, seed, monkeypatch):
    lines, rules = made_up(seed)
    monkeypatch.setattr(rule_tables, "LINES", 8)  # line ends meet in many blocks
    joined = {s: " ".join(own) for s, own in lines.items()}
    want = {(s, r[0]) for s, text in joined.items() for r in rules if r[2].lower() in text}
    table = spark.createDataFrame(rules, RULES)
    ordered = spark.createDataFrame(rows_of(lines), "source_id long, line_no long, line string")
    for df in (ordered.coalesce(1), ordered.repartition(5), ordered.orderBy(F.rand(seed))):
        for chars in (rule_tables.BLOCK_CHARS, 900):
            got = [tuple(r) for r in rule_tables.line_hits(df, table, chars).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_signals_and_first_rules(spark):
    lines, rules = made_up(7)
    rules = [*rules, (950, 50, "", "default", "WARNING", 0.4)]
    table = spark.createDataFrame(rules, RULES)
    df = spark.createDataFrame(rows_of(lines), "source_id long, line_no long, line string").repartition(3)
    signals = {r["source_id"]: r["signals"] for r in explain.extract_signals(df, table, 4).collect()}
    texts = spark.createDataFrame([(s, " ".join(own), "kept") for s, own in lines.items()] + [(99, None, None), (98, "", None)], "source_id long, body string, label_of string")
    causes = {r["source_id"]: r for r in rule_tables.table_cause(texts, F.col("body"), table).collect()}
    scores = {r["source_id"]: r for r in rule_tables.table_severity(texts, F.col("body"), table).collect()}
    for s, own in lines.items():
        hits = sorted((r for r in rules if r[2].lower() in " ".join(own)), key=lambda r: (r[1], r[0]))
        assert signals[s] == list(dict.fromkeys(r[3] for r in hits))[:4]
        assert (causes[s]["root_cause"], causes[s]["label_of"]) == (hits[0][3], "kept")
        assert scores[s]["severity"] == hits[0][4] and scores[s]["scores"]["HIGH"] == (0.65 if hits[0][4] == "HIGH" else 0.1)
    assert all(causes[s]["root_cause"] == "default" and causes[s]["model_used"] == "fallback-default" for s in (98, 99))


def test_many_rules(spark):
    """A hundred thousand keywords, without a limit on rules."""
    table = spark.range(100_000).select(
        F.col("id").alias("rule_id"), F.lit(1).alias("priority"), F.concat(F.lit("event number "), F.hex("id")).alias("keyword"), F.hex("id").alias("label"),
        F.lit("HIGH").alias("severity"), F.lit(0.5).alias("confidence"),
    )
    df = spark.createDataFrame([(1, 0, "an event"), (1, 1, "number"), (1, 2, "1869F and more"), (2, 0, "event number zz")], "source_id long, line_no long, line string")
    got = {r["source_id"]: r["signals"] for r in explain.extract_signals(df, table).collect()}
    assert got == {1: ["1", "18", "186", "1869", "1869F"], 2: []}


def test_empty_tables_and_gaps(spark):
    df = spark.createDataFrame([(None, 0, "Disk"), (None, 1, None), (None, 2, "full"), (1, 0, "disk"), (1, 2, "full"), (2, 0, "disk full")], "source_id long, line_no long, line string")
    table = spark.createDataFrame([(1, 1, "disk  full", "two", None, None), (2, 1, "disk full", "one", None, None)], RULES)
    got = {r["source_id"]: r["signals"] for r in explain.extract_signals(df, table).where("source_id is not null").collect()}
    assert got == {1: [], 2: ["one"]}
    assert [tuple(r) for r in rule_tables.line_hits(df.where("source_id is null"), table).collect()] == [(None, 1)]
    assert explain.extract_signals(df.limit(0), table).count() == 0
    assert rule_tables.line_hits(df, table.limit(0)).count() == 0
    assert [r["rule_id"] for r in rule_tables.first_rule(df, F.col("line"), table.limit(0)).collect()] == [None] * 6


def test_fixed_rules_of_four_words(spark):
    df = spark.createDataFrame([(1, 0, "the quick"), (1, 1, "brown fox"), (1, 2, "out of memory")], "source_id long, line_no long, line string")
    rules = (Rule(("quick brown fox out of",), "long"), *SIGNALS)
    assert explain.extract_signals(df, rules).first()["signals"] == ["long", "Out of memory"]


def test_keywords_stay_off_the_driver(spark, monkeypatch):
    """Neither signals nor first rules bring a row per rule to the driver, and rules that share a keyword meet a text once."""
    table = spark.range(20_000).select(
        F.col("id").alias("rule_id"), F.lit(1).alias("priority"), F.concat(F.lit("shared words "), F.hex(F.col("id") % 5000)).alias("keyword"),
        F.hex("id").alias("label"), F.lit("HIGH").alias("severity"), F.lit(0.5).alias("confidence"),
    )
    lines = spark.createDataFrame([(k, 0, f"many SHARED words {k:X}") for k in range(300)], "source_id long, line_no long, line string")
    rows, collect = [], type(lines).collect

    def counted(df):
        got = collect(df)
        rows.append(len(got))
        return got

    with monkeypatch.context() as m:
        m.setattr(type(lines), "collect", counted)
        signals = explain.extract_signals(lines, table, 3)
        causes = rule_tables.table_cause(lines, F.col("line"), table)
    assert sum(rows) < 1000
    got = {r["source_id"]: r["signals"] for r in signals.collect()}
    assert got[7] == ["7", "138F", "2717"] and got[0x12] == ["1", "12", "1389"]
    assert {r["source_id"]: r["root_cause"] for r in causes.collect()}[0x12] == "1"


def test_filters_on_bytes_of_any_text(spark):
    """Keywords of every length in letters of one to four bytes, with filters that let nearly everything pass."""
    text = "Straße 東京 ñandú 🙂🙂 z " * 3
    keywords = sorted({text[a : a + n] for a in range(0, 20, 3) for n in (1, 2, 3, 5, 8, 13, 21, 34)})
    table = spark.createDataFrame([(k, k, w, f"L{k}", "HIGH", 0.5) for k, w in enumerate([*keywords, "京東", "🙂z"])], RULES)
    lines = spark.createDataFrame([(1, 0, text[:9]), (1, 1, text[9:]), (2, 0, text), (3, 0, "")], "source_id long, line_no long, line string")
    joined = {1: (text[:9] + " " + text[9:]).lower(), 2: text.lower(), 3: ""}
    want = {(s, k) for s, t in joined.items() for k, w in enumerate([*keywords, "京東", "🙂z"]) if w.lower() in t}
    for chars in (rule_tables.BLOCK_CHARS, 1):
        got = [tuple(r) for r in rule_tables.line_hits(lines, table, chars).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_fixed_rules_read_lines_twice(spark):
    """Once for keywords inside a line, once for those over line ends, whose two sides come from one pass."""
    df = spark.createDataFrame([(1, 0, "Out"), (1, 1, "of"), (1, 2, "MEMORY"), (2, 0, "disk"), (2, 2, "full"), (None, 0, "disk"), (None, 1, "full")], "source_id long, line_no long, line string")
    found = explain.extract_signals(df)
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "simple")
    assert plan.count("Scan ") == 2
    assert {r["source_id"]: r["signals"] for r in found.collect()} == {1: ["Out of memory"], 2: [], None: []}
