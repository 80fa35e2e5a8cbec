"""Golden cases of scalar functions and rules."""

import pytest
from pyspark.sql import functions as F

from logspark.functions import reports, rules, text


def value(spark, data, column, kind="string"):
    return spark.createDataFrame([(data,)], f"x {kind}").select(column.alias("y")).first()["y"]


X = F.col("x")


@pytest.mark.parametrize(
    ("line", "wanted"),
    [("2026 ERROR x", "ERROR"), ("warn only", None), ("info and ERROR", "INFO"), ("Fatal", "FATAL"), ("nothing", None)],
)
def test_level(spark, line, wanted):
    assert value(spark, line, text.extract_level(X)) == wanted


def test_truncate_and_normalize(spark):
    assert len(value(spark, "a" * 3000, text.truncate_text(X))) == 1024
    assert value(spark, " \x1b[31mred\x1b[0m \n", text.normalize_log_line(X)) == "red"


def test_lines_keep_inner_blank_lines(spark):
    assert value(spark, "\n a\r\n\nb  c\n", text.text_lines(X)) == ["a", "", "b ", "c"]
    assert value(spark, "  \n ", text.text_lines(X)) == []


def test_format_log_line(spark):
    got = spark.sql("SELECT 1500L AS t, 'x\n\n' AS m").select(text.format_log_line(F.col("t"), F.col("m")).alias("y")).first()["y"]
    assert got == "1970-01-01T00:00:01.500000+00:00 x"


def test_words_do_not_cut_accented_words(spark):
    assert value(spark, "échec abcé naïve Über_x ok99 1abc the_end plain", text.words(X)) == ["ok99", "the_end", "plain"]


@pytest.mark.parametrize(
    ("line", "wanted"), [("FATAL x", "CRITICAL"), ("an error", "HIGH"), ("warning", "WARNING"), ("fine", "INFO"), ("the room", "CRITICAL")]
)
def test_keyword_severity(spark, line, wanted):
    assert value(spark, line, rules.keyword_severity(X)["severity"]) == wanted


@pytest.mark.parametrize(("line", "wanted"), [("OOM", "CRITICAL"), ("Connection refused", "HIGH"), ("odd", "WARNING")])
def test_root_cause(spark, line, wanted):
    assert value(spark, line, rules.rule_root_cause(X)["severity"]) == wanted


def test_rule_table(spark):
    table = spark.createDataFrame([(1, 2, "b", "B", "HIGH", 0.5), (2, 1, "A", "A", "INFO", 0.4)], "rule_id int, priority int, keyword string, label string, severity string, confidence double")
    got = rules.rules_from_table(table)
    assert [r.label for r in got] == ["A", "B"]
    assert value(spark, "xbx a", rules.rule_root_cause(X, rules=got)["root_cause"]) == "A"


def test_plan_parsing(spark):
    good = '```json\n{"metrics": [{"query_key": "cpu", "dimensions": {"a": "b"}}]}\n```'
    assert value(spark, good, reports.parse_plan(X))["metrics"][0]["query_key"] == "cpu"
    bad = value(spark, "not json", reports.parse_plan(X))
    assert [len(bad[f]) for f in ("metrics", "log_queries", "status_checks", "resource_lookups")] == [0, 0, 0, 0]


def test_section_label_rounds_halves_to_even(spark):
    got = [value(spark, s, reports.section_label(F.lit("g"), F.lit(True), X), "double") for s in (0.125, 0.135, 0.5)]
    assert got == ["[g] (reduced to top 12%)", "[g] (reduced to top 14%)", "[g] (reduced to top 50%)"]


@pytest.mark.parametrize(
    ("pattern", "line", "hit"),
    [("ERROR connection", "connection ERROR", True), ("ERROR connection", "ERROR", False), ("?A ?B", "xB", True), ("?A ?B", "x", False), ("", "x", True)],
)
def test_patterns(spark, pattern, line, hit):
    assert value(spark, line, rules.filter_pattern(X, pattern), "string") is hit
    assert value(spark, line, rules.matches_pattern(X, F.lit(pattern))) is hit


def test_merge_maps(spark):
    got = spark.sql("SELECT map('a', 1, 'b', 2) AS l, map('b', 3) AS r").select(text.merge_maps(F.col("l"), F.col("r")).alias("m")).first()["m"]
    assert got == {"a": 1, "b": 3}
