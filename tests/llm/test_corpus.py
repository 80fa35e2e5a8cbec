"""Language model, near duplicates, decontamination, pages, mixing and the pipeline: brute force and odd input."""

import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from logspark.llm import backoff_lm, common, decontaminate, html_wrapper, mixing, near_dedup, queries, textvec
from logspark.llm.common import save_and_read, save_in_buckets

SF = "/root/testdata/sf0.01"
#: Everything but title and body is template or apart.
PAGE = (
    '<html><head><title>t{k}</title></head><body><div class="top">Our Site</div><div class="content"><h1>{title}</h1>{body}</div>'
    '<div class="note-box">Read on every day</div><footer>f {k}</footer></body></html>'
)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def backoff(rows, order, alpha):
    texts = [words(t) for _, t in rows]
    grams = lambda w, k: Counter(zip(*(w[i:] for i in range(k)), strict=False))
    every = [None] + [sum((grams(w, k) for w in texts), Counter()) for k in range(1, order + 1)]
    total = sum(map(len, texts))
    for (i, _), w in zip(rows, texts, strict=True):
        own = [None] + [grams(w, k) for k in range(1, order + 1)]
        others = lambda g, own=own: every[len(g)][g] - own[len(g)][g]
        score = 0.0
        for at in range(len(w)):
            up = 0
            for k in range(min(order, at + 1), 1, -1):
                g = tuple(w[at - k + 1 : at + 1])
                if others(g) > 0:
                    score += math.log(others(g) / others(g[:-1])) + up * math.log(alpha)
                    break
                up += 1
            else:
                score += math.log(max(others((w[at],)), 0.5) / max(total - len(w), 1)) + up * math.log(alpha)
        yield i, len(w), round(score, 6)


def test_backoff_brute_force(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    for df, order in ((docs, 2), (docs, 3), (odd, 2)):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = backoff_lm.scores(df, order=order, chunk_words=9000, range_grams=5000).collect()
        key = lambda r: repr(r)
        assert sorted(((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in got), key=key) == sorted(backoff(rows, order, 0.4), key=key)
    assert backoff_lm.scores(nothing).count() == 0


def test_backoff_query_uses_trigrams(spark, tmp_path):
    """Where only the word before last tells what follows, trigrams raise the score of the registered query."""
    texts = ["a x c", "b x d"] * 4 + ["a x d"]
    rows = [(k, t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in queries.op1_backoff_scores(spark, str(tmp_path)).collect())
    assert got == sorted(backoff(rows, 3, 0.4)) and got != sorted(backoff(rows, 2, 0.4))


def test_backoff_with_few_marks(spark):
    """Marks that nearly all n-grams share change no score."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = backoff_lm.scores(docs, chunk_words=3000, range_grams=5000, mark_bits=3).collect()
    assert sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in got) == sorted(backoff(rows, 3, 0.4))


def test_backoff_moves_shared_ngrams_only(spark):
    """Chunks stay where they are stored, and n-grams that one chunk has alone do not leave it."""
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(500)) + " end of it") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = backoff_lm.scores(docs, chunk_words=600)
    assert got.count() == 40 and moved(got, "tokens") == 0
    kept = save_in_buckets(backoff_lm.chunks(docs, 600).withColumn("chunk", F.monotonically_increasing_id()), "chunk", "chunks")
    shared = backoff_lm.shared_marks(backoff_lm.mark_tables(kept, 3, 0, backoff_lm.MARK_BITS))
    sent = [len(backoff_lm.unpack_sorted(r["grams"])) for r in backoff_lm.gram_tables(kept, shared, 3, 0).collect()]
    assert 0 < sum(sent) < 40 * 12


def test_packing():
    for v in ([], [0], [5, 1 << 40, 255], list(range(1000))):
        a = np.array(v, np.uint64)
        assert backoff_lm.unpacked(backoff_lm.packed(a)).tolist() == v
        assert backoff_lm.unpack_sorted(backoff_lm.pack_sorted(np.sort(a))).tolist() == sorted(v)


def test_packing_of_uneven_bytes():
    """Word numbers and counts are mostly small; bytes that occur often take less room."""
    values = np.random.default_rng(0).geometric(0.05, 20_000).astype(np.uint64)
    assert len(backoff_lm.packed(values)) < 0.9 * len(values)
    assert backoff_lm.unpacked(backoff_lm.packed(values)).tolist() == values.tolist()


def near_brute(rows):
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append((i, frozenset(zip(*(w[k:] for k in range(5)), strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    top = list(range(len(sets)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                top[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    for a, (i, s) in enumerate(sets):
        c = least.get(find(a)) if s else i
        yield i, len(s), c, True if i is None or c is None else i == c


def test_near_duplicates_brute_force(spark, odd, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    base = docs.collect()[0]["text"]
    edits = [" ".join(w for k, w in enumerate((base + " tail" * 30).split()) if k % 41 != seed) for seed in range(12)]  # a chain of near copies
    edits = spark.createDataFrame([(5000 + k, t) for k, t in enumerate(edits)], "doc_id long, text string")
    for df in (docs.select("doc_id", "text").unionByName(edits), odd):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        got = [tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
        assert sorted(got, key=repr) == sorted(near_brute(rows), key=repr)
    assert near_dedup.near_duplicates(nothing).count() == 0


def test_pipeline_keeps_one_row_of_near_duplicates(spark):
    """Copies at Jaccard 0.8 to 0.85 go; null and repeated ids leave one row a group, and texts of their own stay."""
    base = [f"w{k}" for k in range(200)]
    near = " ".join("other" if k in (40, 80, 120, 160) else w for k, w in enumerate(base))
    shingles = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for t in (" ".join(base), near)]
    assert 0.8 <= len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.85
    copies = [" ".join(f"{x}{k}" for k in range(60)) for x in "abc"]
    rows = [(1, " ".join(base)), (2, near), (5, copies[0]), (5, copies[0]), (None, copies[1]), (None, copies[1]), (6, copies[2]), (2, copies[2] + " end"), (6, "a text of its own"), (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted([rows[0], rows[2], rows[4], rows[7], rows[8], rows[9], rows[10]], key=repr)


def test_rest_finds_links_off_the_star(spark):
    """Members of a bucket that are not linked to its least member, but to each other; blocks of a cut bucket meet too."""
    rng = np.random.default_rng(3)
    pool = [f"w{k}" for k in range(400)]
    a = list(rng.permutation(pool)[:200])
    rows = [(0, " ".join(a))]
    for k in range(1, 40):
        b = list(a)
        for at in rng.choice(200, 4 + 6 * (k % 3), replace=False):
            b[at] = f"n{k % 5}-{at}"
        rows.append((k, " ".join(b)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old, near_dedup.BLOCK = near_dedup.BLOCK, 4
    try:
        got = [tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    finally:
        near_dedup.BLOCK = old
    assert sorted(got, key=repr) == sorted(near_brute(rows), key=repr)


def test_rest_grows_with_members(spark):
    """A bucket of many look-alikes in components of their own gives few pairs at once, and says that more are left; asked for the whole, all."""
    n = 300
    reps = spark.range(n).select(F.col("id").alias("rep"))
    buckets = reps.select(F.lit(1).cast("long").alias("key"), "rep", F.lit(0).cast("long").alias("pivot"))
    sketch = reps.select("rep", F.lit(40).cast("long").alias("n"), F.array(*[F.lit(3).cast("long")] * near_dedup.MAP_WORDS).alias("cells"))
    alone = reps.select(F.col("rep").alias("node"), F.col("rep").alias("component"))
    got = near_dedup.rest(buckets, sketch, alone, 85).collect()
    assert len(got) < 4 * n
    assert sum(r["omitted"] for r in got) > 0
    every = {(a, b) for a in range(1, n) for b in range(1, a)}
    assert {(r["a"], r["b"]) for r in near_dedup.rest(buckets, sketch, alone, 85, whole=True).collect()} == every


def test_rest_of_large_families(spark):
    """Families of near copies whose star joins few of them: passes give the components of brute force."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(90):
        text = list(base)
        for at in rng.choice(120, 1 + k % 4, replace=False):
            text[at] = f"n{k}-{at}"
        rows.append((k, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    few, near_dedup.FEW = near_dedup.FEW, 0
    block, near_dedup.BLOCK = near_dedup.BLOCK, 16
    try:
        got = [tuple(r) for r in near_dedup.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    finally:
        near_dedup.FEW, near_dedup.BLOCK = few, block
    assert sorted(got, key=repr) == sorted(near_brute(rows), key=repr)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 100).astype(np.uint64)])
    same = (near_dedup.signature(a) == near_dedup.signature(b)).mean()
    assert abs(same - 900 / 1100) < 0.1


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 60)] + [(100, 90), (100, 95), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in near_dedup.components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 61)}, 90: 90, 95: 90, 100: 90}


def smith_waterman(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        a, b = (rng.integers(0, 6, n).astype(np.uint64) for n in rng.integers(1, 25, 2))
        assert decontaminate.align(a, b)[0] == smith_waterman(a.tolist(), b.tolist())


def test_decontamination(spark, odd, nothing):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = items.orderBy("item_id").collect()
    first = item[0]["text"].split()
    edited = " ".join("changed" if k % 6 == 5 else w for k, w in enumerate(first))
    rows = [(7000, "before " * 30 + item[1]["text"] + " after" * 30), (7001, "some more words here " + edited + " and the end"), (7002, item[2]["text"].upper()), (7003, "words of no test")]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(planted)
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(every, items).collect()}
    assert {(7000, item[1]["item_id"]), (7001, item[0]["item_id"]), (7002, item[2]["item_id"])} <= got and not {g for g in got if g[0] == 7003}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {(d, r["item_id"]) for r in item for d, t in texts.items() if r["text"] in t} <= got
    blocks = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(every, items, block_words=300).collect()}
    assert {g for g in got if g[0] >= 7000} <= blocks
    odd_items = spark.createDataFrame([(1, None), (2, ""), (3, "zzzq"), (None, "zzzq yyyq"), (1, None)], "item_id long, text string")
    assert decontaminate.matches(odd, odd_items).count() == 0
    assert decontaminate.matches(nothing, items).count() == 0 and decontaminate.matches(odd, odd_items.limit(0)).count() == 0
    assert decontaminate.keep_clean(odd, items).count() == odd.count()


def test_part_of_a_long_item(spark):
    """A verbatim third of an item is a leak, edited or not; the same words in another order are not."""
    items = spark.createDataFrame([(1, " ".join(f"rare{k}" for k in range(60)))], "item_id long, text string")
    third = [f"rare{k}" for k in range(20, 36)]
    edited = [w if k % 6 != 5 else "changed" for k, w in enumerate(f"rare{k}" for k in range(20, 38))]
    rows = [(1, " ".join(["x"] * 30 + third + ["y"] * 30)), (2, " ".join(["x"] * 30 + edited + ["y"] * 30)), (3, " ".join(third[::-1])), (4, "rare1 rare2 rare3 and no more")]
    rows += [(10 + k, " ".join(f"w{(k * 7 + j * j) % 97}" for j in range(400))) for k in range(40)]
    got = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and all(r["similarity"] < 0.3 for r in got)
    assert [(r["begin_word"], r["end_word"]) for r in got if r["doc_id"] == 1] == [(30, 46)]


def test_pages_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    got = {r["page_id"]: r["text"] for r in html_wrapper.main_texts(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.DOTALL)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(b for b in blocks if b)


def test_wrapper_finds_template(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k=k, title=f"Title {k}", body=f"<p>Body {k} one</p>" * (k % 3 + 1))) for k in range(12)]
    rows += [(20, None, None), (21, "http://h.example/x", ""), (22, "not a url", "<p>only &amp; text"), (3, "http://h.example/3", rows[3][2]), (23, "u", "<div>" * 3000 + "deep")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    for limit in (html_wrapper.BROADCAST_GROUPS, 0):
        got = html_wrapper.main_texts(df, limit).collect()
        assert len(got) == len(rows)
        text = {r["page_id"]: r["text"] for r in got}
        assert text[4] == "Title 4\n\nBody 4 one\n\nBody 4 one" and text[20] == text[21] == "" and text[22] == "only & text" and text[23] == "deep"
        assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_wrapper.main_texts(df.limit(0)).count() == 0


def test_tree_matching():
    t = lambda label, *kids: [label, 0, list(kids)]
    a, b = t("r", t("x"), t("y", t("z")), t("w")), t("r", t("y", t("q"), t("z")), t("w"), t("v"))
    n, pairs = html_wrapper.match(a, b)
    assert n == 4 and sorted(pairs) == [(0, 0), (2, 1), (3, 3), (4, 4)]
    assert html_wrapper.aligned(a, a) == {k: k for k in range(5)}


def plain_matching(a, b):
    if a[0] != b[0]:
        return 0
    best = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for x, c in enumerate(a[2]):
        for y, d in enumerate(b[2]):
            best[x + 1][y + 1] = max(best[x][y + 1], best[x + 1][y], best[x][y] + plain_matching(c, d))
    return best[-1][-1] + 1


def test_tree_matching_is_the_best():
    rng = np.random.default_rng(7)

    def tree(depth):
        return [str(rng.choice(list("abc"))), 0, [tree(depth - 1) for _ in range(rng.integers(0, 4))] if depth else []]

    for _ in range(300):
        a, b = tree(3), tree(3)
        a[0] = b[0] = "r"
        if rng.random() < 0.5:  # much in common
            b[2] = a[2][:1] + b[2] + a[2][1:]
        n, pairs = html_wrapper.match(a, b)
        assert n == len(pairs) == plain_matching(a, b)
        assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == n
    long = lambda k: ["ul", 0, [["li", 0, [["p", 0, []]]] for _ in range(k)]]
    assert html_wrapper.match(long(3000), long(3001))[0] == 6001


def test_article_keeps_constant_text(spark):
    """What all pages of a host say inside a marked article is article; what they say outside is not."""
    page = '<body><div class="x">Our Site</div><article><h1>Summary</h1><p>Body {k} of this page.</p><p>Thanks for reading our paper.</p></article><p>More of us</p></body>'
    rows = [(k, f"http://h.example/{k}", page.format(k=k)) for k in range(12)]
    got = html_wrapper.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {f"Summary\n\nBody {k} of this page.\n\nThanks for reading our paper." for k in range(12)}


def water_filling(sizes, weights, cap):
    """Share by weight; who is above the cap stops there and the rest is shared again."""
    left, target = float(sum(sizes)), [None] * len(sizes)
    while True:
        open_ = [k for k, t in enumerate(target) if t is None]
        share = {k: left * weights[k] / sum(weights[j] for j in open_) for k in open_}
        over = [k for k in open_ if share[k] >= cap * sizes[k]]
        if not over:
            return [share.get(k, t) if t is None else t for k, t in enumerate(target)]
        for k in over:
            target[k] = float(cap * sizes[k])
            left -= target[k]
        if len(over) == len(open_):
            return target


def test_mixing(spark, odd, nothing):
    small = spark.createDataFrame([(100 + k, "w " * n, "en", s, 0) for k, (n, s) in enumerate([(1, "d"), (2, "e"), (900, "a"), (3, "f")])], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (small, odd.unionByName(small, allowMissingColumns=True)):
        sized, goals, taken = mixing.mix(docs, block_words=64)
        rows = mixing.taken_words(sized, goals, taken).collect()
        assert len(rows) == docs.count()
        by = {}
        for r in rows:
            assert r["taken"] <= 3 * r["size"]
            by.setdefault(r["source"], [0, 0, r["source_size"], r["target"]])
            by[r["source"]][0] += r["size"]
            by[r["source"]][1] += r["taken"]
        names = sorted(by, key=lambda s: (s is None, s or ""))
        want = water_filling([by[s][0] for s in names], [(1, 2, 3)[k % 3] for k in range(len(names))], 3)
        for s, target in zip(names, want, strict=True):
            size, took, given, goal = by[s]
            assert size == given and abs(goal - target) < 1e-6 * max(1, target) and abs(took - target) <= 0.5 + 1e-6
        places = taken.groupBy("row", "block", "pass").count().where("count > 1").count()
        assert places == 0
    again = mixing.taken_words(*mixing.mix(docs.repartition(2), block_words=64)).select("doc_id", "size", "taken").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.taken_words(sized, goals, taken).select("doc_id", "size", "taken").collect())
    per_shard = sorted(r["n"] for r in taken.groupBy("shard").agg(F.count("*").alias("n")).collect())
    assert per_shard[-1] - per_shard[0] <= 4
    assert mixing.taken_words(*mixing.mix(nothing)).count() == 0


def test_hypergeometric_draws(spark):
    df = spark.range(4000).select(mixing.hypergeometric(F.lit(50), F.lit(20), F.lit(10), mixing.uniform("id", F.lit(0)), mixing.uniform("id", F.lit(1))).alias("x"))
    n = Counter(r["x"] for r in df.collect())
    for k in range(11):
        p = math.comb(20, k) * math.comb(30, 10 - k) / math.comb(50, 10)
        assert abs(n[k] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) + 1e-3


def test_textvec_pieces_agree():
    import pyarrow as pa

    texts = ["Hello  World hello", None, "", " a b\n", "x", "Hello world HELLO", "é à"]
    seen = []
    for limit in (1, 7, 1 << 20):
        out = []
        for piece in textvec.pieces(pa.array(texts), limit):
            piece.words()
            out += [piece.hashes[piece.at[r] : piece.at[r + 1]].tolist() for r in range(piece.rows)]
        seen.append(out)
    assert seen[0] == seen[1] == seen[2] and [len(x) for x in seen[0]] == [3, 0, 0, 2, 1, 3, 2] and seen[0][0] == seen[0][5]


def test_pipeline(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = save_and_read(stage(spark, before, "/root/testdata/sf0.001"), f"test-{name}")
        assert after.columns == docs.columns and after.select("doc_id").subtract(before.select("doc_id")).count() == 0
        before = after
    last = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert sorted(r["doc_id"] for r in last.collect()) == sorted(r["doc_id"] for r in before.collect())
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, "/root/testdata/sf0.001")
        assert out.count() <= odd.count() and (name == "mixture" or out.columns == odd.columns)
        assert stage(spark, odd.limit(0), "/root/testdata/sf0.001").count() == 0


def test_flags_of_ids(spark):
    """Every id of the list is flagged, also with a filter far too small, and few others are otherwise; null is not among ids."""
    ids = spark.range(0, 60_000, 3).select((F.col("id") * 1_000_003 - 7).alias("x"))
    rows = spark.range(60_000).select(F.when(F.col("id") > 0, F.col("id") * 1_000_003 - 7).alias("doc_id"), (F.col("id") % 3 == 0).alias("listed"))
    for most in (common.MOST_BITS, common.MAP_BITS):
        got = common.flag_among(rows, "doc_id", ids, "flag", most).where("doc_id is not null").groupBy("listed").agg(F.avg(F.col("flag").cast("int")).alias("share")).collect()
        share = {r["listed"]: r["share"] for r in got}
        assert share[True] == 1 and (share[False] < 0.1 or most == common.MAP_BITS)
    assert common.flag_among(rows, "doc_id", ids.limit(0), "flag").where("flag").count() == 0


def test_texts_without_a_mate_stay_in_place(spark):
    """Neither the verification of a few pairs nor the choice of rows shuffles the texts of all others."""
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, text(k)) for k in range(2000)] + [(2000, text(1)), (2001, text(2) + " end")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = save_and_read(docs, "mates")
    pairs = spark.createDataFrame([(2000, 1), (2001, 2)], "a long, b long")
    for df, n in ((near_dedup.verify(pairs, docs.select("doc_id", "text")), 2), (corpus_pipeline.near_duplicates(spark, docs, ""), 2000)):
        assert df.count() == n
        assert moved(df, "text") < 100


def moved(df, column):
    """Rows with ``column`` that a run of ``df`` shuffles."""
    query = df._jdf.queryExecution()
    query.toRdd().count()

    def rows(node):
        name = node.nodeName()
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else [node.children().apply(k) for k in range(node.children().size())]
        own = node.metrics().apply("shuffleRecordsWritten").value() if name == "Exchange" and column in node.output().toString() else 0
        return own + sum(map(rows, inner))

    return rows(query.executedPlan())
