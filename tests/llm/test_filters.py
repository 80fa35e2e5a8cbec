"""Quality, toxicity, rules, licences and secrets: brute force, held-out accuracy and odd input."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from logspark.llm import decontaminate, licenses, ngram_llr, quality_qda, queries, secret_scan, toxicity_knn

SF = "/root/testdata/sf0.01"


def held_out_accuracy(df, column, remainder):
    labels = df.sparkSession.read.parquet(f"{SF}/labels.parquet").select("doc_id", column)
    rows = df.join(labels, "doc_id").where("held_out").select("predicted", column).collect()
    assert all(0 <= r["score"] <= 1 for r in df.select("score").collect())
    return sum(a == b for a, b in rows) / len(rows), rows


def test_quality_held_out(spark):
    accuracy, rows = held_out_accuracy(queries.op2_quality_discriminant(spark, SF), "quality", 2)
    assert accuracy >= 0.95 and sum(p for p, q in rows if q) >= 0.97 * sum(q for _, q in rows)


def test_toxicity_held_out(spark):
    accuracy, _ = held_out_accuracy(queries.op3_toxicity_neighbours(spark, SF), "toxic", 1)
    assert accuracy >= 0.92  # labels of the small table are noisy


def test_quality_odd(odd, nothing, labels, nobody):
    out = quality_qda.quality_scores(odd, labels, nobody)
    rows = out.collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality_qda.quality_scores(nothing, labels, nobody).count() == 0
    assert {r["score"] for r in quality_qda.quality_scores(odd, labels.where("quality = 0"), nobody).collect()} == {0.0}
    assert {r["score"] for r in quality_qda.quality_scores(odd, labels.limit(0), nobody).collect()} == {1.0}
    assert quality_qda.keep_good(odd, labels.limit(0), nobody).columns == odd.columns


def test_toxicity_odd(odd, nothing, labels, nobody):
    rows = toxicity_knn.toxicity_scores(odd, labels, nobody).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity_knn.toxicity_scores(nothing, labels, nobody).count() == 0
    assert {r["score"] for r in toxicity_knn.toxicity_scores(odd, labels.limit(0), nobody).collect()} == {0.0}


def test_nearest_is_exact():
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [{"doc_id": i, "label": i % 2, "term": sorted(rng.choice(40, 6, replace=False).tolist()), "n": rng.integers(1, 5, 6).tolist()} for i in range(500)]
    index = toxicity_knn.build(rows, rng.integers(1, 400, 40).astype(float), 500)
    dense = np.zeros((500, 40))
    for t in range(40):
        own = slice(index.begin[t], index.begin[t + 1])
        dense[index.example[own], t] = index.weight[own]
    for r in rows[:60]:
        best, score = index.nearest(np.array(r["term"]), np.array(r["n"]), 7)
        q = np.zeros(40)
        q[r["term"]] = index.vector(np.array(r["term"]), np.array(r["n"]))
        want = dense @ q
        order = np.lexsort((np.arange(500), -np.round(want, 9)))[:7]
        assert best.tolist() == order.tolist() and np.allclose(score, want[order])


def base_rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rules_brute_force(spark, odd, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: tuple(r[c] for c in BASE) for r in queries.op9_ngram_likelihood_ratio(spark, SF).collect()}
    assert got == {r["doc_id"]: base_rules(r["text"]) for r in docs.collect()}
    rows = ngram_llr.quality_rules(odd, labels).collect()
    assert sorted(tuple(r[c] for c in BASE) for r in rows) == sorted(base_rules(r["text"]) for r in odd.collect())
    assert all(not r["kept"] for r in rows if r["base_failed"])


def test_rules_judge_labels(spark):
    quality = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = queries.op9_ngram_likelihood_ratio(spark, SF).join(quality, "doc_id").where("not base_failed").collect()
    assert sum(r["kept"] == (r["quality"] == 1) for r in rows) >= 0.97 * len(rows)


def test_rules_without_trusted(odd, nothing, labels):
    assert {r["score"] for r in ngram_llr.quality_rules(odd, labels.limit(0)).collect()} == {0.0}
    assert ngram_llr.quality_rules(nothing, labels).count() == 0


def test_rules_count_all_trusted(spark):
    """Where every document is trusted, target and raw shares are equal; blocks of ids add up to the same counts."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("w"), F.col("id") % 3000).alias("text"))
    assert all(abs(r["weight"]) < 1e-9 for r in ngram_llr.weights(docs, docs.select("doc_id"), prior=1.0).collect())
    some = docs.where("doc_id % 3 = 0").select("doc_id")
    whole, cut = ({r["bucket"]: r["weight"] for r in ngram_llr.weights(docs, some, prior=1.0, **k).collect()} for k in ({}, {"id_block": 900}))
    assert whole.keys() == cut.keys() and all(abs(w - cut[b]) < 1e-9 for b, w in whole.items()) and max(whole.values()) > 0.5


@pytest.mark.parametrize("table", ["documents", "odd"])
def test_licenses_sql(spark, odd, table):
    docs = spark.read.parquet(f"{SF}/documents.parquet") if table == "documents" else odd
    extra = [(90000, licenses.MIT.upper().replace(",", " ,")), (90001, "Copyright (c) 2020 Me\nAll rights reserved.\n" + licenses.ISC), (90002, "x\nReleased under the MIT Licence\ny")]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    got = licenses.scan(docs).toPandas()
    documents = docs.toPandas()  # noqa: F841 - read by DuckDB
    want = duckdb.sql(licenses.duckdb_sql()).df()[list(got.columns)]
    key = lambda df: sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False)))
    assert [re.sub(r"\.0\b", "", x) for x in key(got)] == [re.sub(r"\.0\b", "", x) for x in key(want)]
    found = got.set_index("doc_id")
    assert found.loc[90000].text_license == "MIT" and found.loc[90001].text_license == "ISC" and found.loc[90002].line_licenses == "MIT"


def test_licenses_empty(nothing):
    assert licenses.scan(nothing).count() == 0


def base_sha(text):
    assign = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    spans = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return hashlib.sha256(spans.encode()).hexdigest(), [sum(k == j for _, k, _ in found) for j in range(3)]


def test_secrets_brute_force(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = queries.op6_secret_ownership(spark, SF).collect()
    want = {r["doc_id"]: base_sha(r["text"]) for r in docs.collect()}
    assert {r["doc_id"]: (r["base_sha256"], [r["n_assign"], r["n_access"], r["n_hex"]]) for r in rows} == want
    assert secret_scan.report(secret_scan.secrets(odd)).count() == odd.count()
    assert secret_scan.report(secret_scan.secrets(nothing)).count() == 0


def test_ownership_separates(spark):
    live, common, dummy = "9f8a7b6c5d4e3f2a1b0c", "q8w7e6r5t4y3u2i1o0p9", "xxxxxxxxxxxxxxxx"
    rows = [(1, f"é token={live} end", "en", "a"), (2, f"PASSWORD: '{dummy}'", "en", "a")]
    rows += [(10 + i, f"secret = {common}", "en", f"s{i}") for i in range(5)] + [(20, "token=token:abcdefghij", "en", "a"), (21, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.lit(0).cast("long"))
    out = {r["doc_id"]: r for r in secret_scan.report(secret_scan.secrets(docs)).collect()}
    assert out[1]["n_live"] == 1 and out[1]["spans"] == "assign:2:28" and out[2]["n_live"] == 0 and out[2]["n_assign"] == 1
    assert all(out[10 + i]["n_live"] == 0 and out[10 + i]["n_assign"] == 1 for i in range(5)) and out[20]["n_assign"] == 0
    kept = {r["doc_id"]: r for r in secret_scan.redact(docs).collect()}
    assert kept[1]["text"] == "é [SECRET] end" and kept[1]["n_chars"] == 14 and kept[10]["n_chars"] == 0 and common in kept[10]["text"] and kept[21]["text"] is None


def test_rows_with_the_same_id_are_judged_apart(spark, labels, nobody):
    """Null and repeated ids: secrets go from the rows that hold them, and only rejected rows are dropped."""
    first, second = "9f8a7b6c5d4e3f2a1b0c", "q8w7e6r5t4y3u2i1o0p9"
    for key in (7, None):
        rows = [(key, f"token={first} end", "en", "a", 1), (key, f"a longer text before secret: {second}", "en", "a", 2), (key, "clean words that stay as they are", "en", "a", 3)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        got = sorted(r["text"] for r in secret_scan.redact(docs).collect())
        assert got == ["[SECRET] end", "a longer text before [SECRET]", "clean words that stay as they are"]
        item = spark.createDataFrame([(1, "a longer text before secret")], "item_id long, text string")
        assert sorted(r["n_chars"] for r in decontaminate.keep_clean(docs, item).collect()) == [1, 3]
    held_out = queries.quality_held_out
    docs, known = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_qda.quality_scores(docs, known, held_out).cache()
    bad, good = (scored.where(f"predicted = {k}").select("doc_id").first()[0] for k in (0, 1))
    extra = docs.where(F.col("doc_id").isin(bad, good)).withColumn("doc_id", F.lit(None).cast("long"))
    kept = quality_qda.keep_good(docs.unionByName(extra), known, held_out)
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id is not null").count() == scored.where("predicted = 1").count()


def test_registered_with_guard():
    assert {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in entry.queries() if re.match(r"op\d+_", q)} and "pipeline" in entry.queries()


def test_buckets_are_hashed_outside_of_array_functions(spark):
    df = spark.createDataFrame([(0, []), (1, ["a"]), (2, ["a", "b", "a"])], "row long, _tokens array<string>")
    made = ngram_llr.with_buckets(df)
    got = [tuple(r) for r in made.where("row > 0").collect()]
    one = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w)), F.lit(1 << 16))).first()[0] for w in "ab"}
    two = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w[0]), F.lit(w[1]), F.lit(2)), F.lit(1 << 16))).first()[0] for w in ("ab", "ba")}
    assert [tuple(r) for r in made.where("row = 0").collect()] == [(0, None, None)]
    assert sorted(got, key=str) == sorted([(1, one["a"], None), (2, one["a"], two["ab"]), (2, one["b"], two["ba"]), (2, one["a"], None)], key=str)
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    plan = spark._jvm.PythonSQLUtils.explainString(made._jdf.queryExecution(), "simple")
    assert "lambda" not in plan and ngram_llr.quality_rules(docs, docs.limit(0)).count() == 2
