r"""Conversation structure repair: the cheapest edits that make the roles of a conversation follow ``(s?(ua)+)?``, by iterative-deepening A*.

Edits are tried in ASCII order of their initials: Delete (4, required for blank and duplicate rows), Insert an empty turn of the user or the assistant
(3, before any row or at the end), Keep (0), Rerole to user or assistant (3); a truncated row that is not deleted adds 3. What may follow depends on four
states alone (nothing yet, after ``s``, after ``u``, after ``a``), which also fix the role of an inserted or reroled turn.

``repair`` searches depth first under a bound on the cost. The bound starts at an admissible estimate (faults of single rows and of neighbours) and grows
to the least cost that exceeded it. A table of failed states holds what is known to be needed from each (row, state), also for later bounds, so
a state is searched again only when more may be spent from it. As edits are tried in order, the first accepting path is the least audit of all cheapest ones.

Rows are shuffled once by conversation and read in order, one conversation at a time. Conversations of more than ``SEGMENT`` rows take another way: rows are
numbered across tasks, cut into segments, every segment is searched for each pair of a first and a last state, and costs (sixteen numbers a segment) are
joined along the conversation. The results are the same; only the hash over a conversation's whole repaired text is computed by one task, as a stream.

A row's first fault counts: blank (no ``[^\x20\x09-\x0D]``), duplicate (role and text of an earlier row), truncated (last such character is not one of
``.!?``). Defined results: null roles and texts are one space; null turns come first; rows of one turn are ordered by role, then text; rows without
``conv_id`` are one conversation. A role that starts with none of ``s``, ``u``, ``a`` (also an empty one) can only be reroled or deleted. A conversation without rows
has zeros, an empty audit and the hash of an empty text. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import map_partitions, save_and_read
from logspark.operators.ordering import number_rows, text_key
from logspark.session import ship

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
ENDS = ".!?"
#: Rows that are searched together.
SEGMENT = 512
#: Initials as states: 1 after s, 2 after u, 3 after a; 0 is the start, and an initial that no state can follow.
INITIALS = {"s": 1, "u": 2, "a": 3}
FORCED = (2, 2, 3, 2)
ROLES = {2: "user", 3: "assistant"}
ACCEPTING = (0, 3)
LEGAL = {(1, 2), (2, 3), (3, 2)}
NEVER = 1 << 40
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)

#: A row as the search sees it: its initial's state, whether it must go, whether it is truncated.
Row = tuple[int, bool, bool]


def estimate(rows: list[Row]) -> list[int]:
    """For each place a cost that the rows from there on need at least: of single rows, or of two kept neighbours that cannot follow each other."""
    n = len(rows)
    out = [0] * (n + 1)
    later = None  # the next row that need not go
    for i in range(n - 1, -1, -1):
        initial, gone, cut = rows[i]
        alone = DELETE if gone else (min(DELETE, REROLE + TRUNCATED) if cut else REROLE) if not initial else TRUNCATED if cut else 0
        out[i] = out[i + 1] + alone
        if gone:
            continue
        if later is not None and initial and rows[later][0] and (initial, rows[later][0]) not in LEGAL:
            pair = 1 if cut or rows[later][2] else 3
            rest = out[later + 1] + (TRUNCATED if rows[later][2] else 0) + DELETE * sum(rows[k][1] for k in range(i + 1, later))
            out[i] = max(out[i], alone + rest + pair)
        later = i
    return out


def repair(rows: list[Row], entry: int = 0, goals: tuple[int, ...] = ACCEPTING, tail: bool = True) -> tuple[int, str]:
    """Least cost and audit from state ``entry`` to one of ``goals``; ``tail`` allows inserted turns after the last row."""
    n = len(rows)
    known = [[e] * 4 for e in estimate(rows)]
    for state in range(4):
        if state not in goals:
            known[n][state] = INSERT if tail else NEVER
    while True:
        bound = known[0][entry]
        path = _search(rows, entry, goals, tail, known, bound)
        if path is not None:
            return bound, path


def _search(rows: list[Row], entry: int, goals: tuple[int, ...], tail: bool, known: list[list[int]], bound: int) -> str | None:
    """The first accepting path that costs ``bound`` at most; where there is none, ``known`` rises."""
    n = len(rows)
    stack = [[0, entry, 0, 0, NEVER]]  # row, state, cost, next edit, least need seen from here
    path: list[str] = []
    while stack:
        top = stack[-1]
        i, state, cost, edit, least = top
        if edit == 0 and i == n and state in goals:
            return "".join(path)
        if edit == 4:
            stack.pop()
            if least > known[i][state]:
                known[i][state] = least
            if stack:
                path.pop()
                parent = stack[-1]
                need = cost - parent[2] + known[i][state]
                if need < parent[4]:
                    parent[4] = need
            continue
        top[3] += 1
        if edit == 1:  # insert
            if i == n and not tail:
                continue
            after = (i, FORCED[state], INSERT)
            letter = "I"
        elif i == n:
            continue
        else:
            initial, gone, cut = rows[i]
            extra = TRUNCATED if cut else 0
            if edit == 0:
                after, letter = (i + 1, state, DELETE), "D"
            elif gone:
                continue
            elif edit == 2:
                if not (initial == FORCED[state] or (initial == 1 and state == 0)):
                    continue
                after, letter = (i + 1, initial, extra), "K"
            else:
                after, letter = (i + 1, FORCED[state], REROLE + extra), "R"
        need = after[2] + known[after[0]][after[1]]
        if cost + need > bound:
            if need < top[4]:
                top[4] = need
            continue
        path.append(letter)
        stack.append([after[0], after[1], cost + after[2], 0, NEVER])
    return None


def repaired_lines(roles: list[str], texts: list[str], audit: str, state: int = 0) -> Iterator[str]:
    """``role:text`` of every row that the edits leave or insert, from state ``state`` on."""
    at = 0
    for edit in audit:
        if edit == "I":
            state = FORCED[state]
            yield ROLES[state] + ":"
            continue
        if edit == "K":
            state = INITIALS[roles[at][0]]
            yield f"{roles[at]}:{texts[at]}"
        elif edit == "R":
            state = FORCED[state]
            yield f"{ROLES[state]}:{texts[at]}"
        at += 1


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the damage that a hash of conversation and turn sets; ``copies`` 0 marks a dropped row."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    out = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), word("role").alias("role"), word("text").alias("text"), kind.alias("kind"))
    return out.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def whole(conv_id: int | None, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result row of one conversation, from its rows in order."""
    seen, rows, counts = set(), [], [0, 0, 0]
    for role, text in zip(roles, texts, strict=True):
        filled = text.rstrip(SPACES)
        fault = 0 if not filled else 1 if (role, text) in seen else 2 if filled[-1] not in ENDS else 3
        if fault < 3:
            counts[fault] += 1
        seen.add((role, text))
        rows.append((INITIALS.get(role[:1], 0), fault < 2, fault == 2))
    illegal = sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
    known = [t for t in turns if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    cost, audit = repair(rows)
    digest = hashlib.sha256("\n".join(repaired_lines(roles, texts, audit)).encode()).hexdigest()
    return (conv_id, gaps, *counts, illegal, cost, audit, digest)


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _short(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")

    def walk(batches):
        at, turns, roles, texts, out, begun = None, [], [], [], [], False
        for batch in batches:
            for conv_id, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if begun and conv_id != at:
                    out.append(whole(at, turns, roles, texts))
                    turns, roles, texts = [], [], []
                at, begun = conv_id, True
                turns += [turn] * copies
                roles += [role] * copies
                texts += [text] * copies
            if len(out) >= 1000:
                yield dict(zip(NAMES, map(list, zip(*out, strict=True)), strict=True))
                out = []
        if begun:
            out.append(whole(at, turns, roles, texts))
            yield dict(zip(NAMES, map(list, zip(*out, strict=True)), strict=True))

    return map_partitions(ordered, RESULT, walk)


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def segment_costs(rows: list[Row], last: bool) -> dict:
    """Cost, audit and the audit's rank for each pair (first state, last state) as ``4 * first + last``; the last segment has one way out, 0."""
    n = len(rows)
    costs, audits = [NEVER] * 16, [""] * 16
    for entry in range(4):
        if last:
            costs[4 * entry], audits[4 * entry] = repair(rows, entry)
            continue
        for leave in (2, 3):
            costs[4 * entry + leave], audits[4 * entry + leave] = repair(rows, entry, (leave,), False)
        if entry < 2:  # nothing was kept
            costs[5 * entry], audits[5 * entry] = DELETE * n, "D" * n
        keep = [(DELETE * (n - 1) + (TRUNCATED if cut else 0), "D" * k + "K" + "D" * (n - 1 - k)) for k, (s, gone, cut) in enumerate(rows) if s == 1 and not gone]
        if entry == 0 and keep:
            costs[1], audits[1] = min(keep)
    order = {a: k for k, a in enumerate(sorted(set(audits)))}
    return {"cost": costs, "audit": audits, "place": [order[a] for a in audits]}


def choose(costs: list[list[int]], places: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Least cost through all segments, and for each its first and last state; of equal costs the least audit."""
    need = [[NEVER] * 4 for _ in costs] + [[0, NEVER, NEVER, NEVER]]
    for k in range(len(costs) - 1, -1, -1):
        need[k] = [min(costs[k][4 * a + b] + need[k + 1][b] for b in range(4)) for a in range(4)]
    state, out = 0, []
    for k, cost in enumerate(costs):
        ways = [b for b in range(4) if cost[4 * state + b] + need[k + 1][b] == need[k][state]]
        leave = min(ways, key=lambda b: places[k][4 * state + b])
        out.append((state, leave))
        state = leave
    return need[0][0], out


def _long(rows: DataFrame, segment: int) -> DataFrame:
    spark = rows.sparkSession
    each = rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("uid", F.monotonically_increasing_id())
    each = save_and_read(each, "repair-rows")
    first = F.coalesce("turn", F.lit(-(1 << 63)).cast("long"))
    numbered = number_rows(each, ["conv_id"], first, F.struct("role", "text", "copy", "uid"), second_key=text_key(F.col("role")), out="at")
    numbered = numbered.withColumns({"segment": F.floor(F.col("at") / segment), "digest": F.sha2("text", 256)})
    numbered = save_and_read(numbered, "repair-numbered")
    again = numbered.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.min("at").alias("earliest"), F.count("*").alias("n"))
    again = again.where("n > 1").drop("n")
    match = same(F.col("conv_id"), F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    filled = F.expr("trim(TRAILING ' \\t\\n\\u000b\\f\\r' FROM text)")
    fault = F.when(F.length(filled) == 0, 0).when(F.col("at") > F.col("earliest"), 1).when(~F.right(filled, F.lit(1)).isin(*ENDS), 2).otherwise(3)
    initial = F.coalesce(*(F.when(F.left("role", F.lit(1)) == k, v) for k, v in INITIALS.items()), F.lit(0))
    known = numbered.join(again, match, "left").select("conv_id", "segment", "at", "turn", fault.alias("fault"), initial.alias("initial"))
    known = save_and_read(known, "repair-faults")
    facts = known.groupBy("conv_id").agg(
        *(F.count_if(F.col("fault") == k).alias(n) for k, n in enumerate(NAMES[2:5])),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"), F.max("segment").alias("last"),
    )
    facts = save_and_read(facts, "repair-facts")
    lasts = facts.select(F.col("conv_id").alias("_c"), "last")
    ready = known.join(lasts, same(F.col("conv_id"), F.col("_c"))).select("conv_id", "segment", "at", "fault", "initial", (F.col("segment") == F.col("last")).alias("is_last"))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        fault, initial = table.column("fault").to_pylist(), table.column("initial").to_pylist()
        found = segment_costs([(s, f < 2, f == 2) for s, f in zip(initial, fault, strict=True)], table.column("is_last")[0].as_py())
        illegal = sum(p not in LEGAL for p in zip(initial, initial[1:], strict=False))
        out = {"conv_id": table.column("conv_id")[:1], "segment": table.column("segment")[:1], "begin": [initial[0]], "end": [initial[-1]], "illegal": [illegal]}
        return pa.table(out | {k: [v] for k, v in found.items()}, schema=searched)

    searched = pa.schema(
        [("conv_id", pa.int64()), ("segment", pa.int64()), ("begin", pa.int32()), ("end", pa.int32()), ("illegal", pa.int64()), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string())), ("place", pa.list_(pa.int32()))]
    )
    ship(spark)
    schema = "conv_id long, segment long, begin int, end int, illegal long, cost array<long>, audit array<string>, place array<int>"
    found = save_and_read(ready.groupBy("conv_id", "segment").applyInArrow(search, schema), "repair-segments")

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("segment")
        rows = table.to_pylist()
        cost, ways = choose([r["cost"] for r in rows], [r["place"] for r in rows])
        illegal = sum(r["illegal"] for r in rows) + sum((a["end"], b["begin"]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
        return pa.table(
            {
                "conv_id": table.column("conv_id"), "segment": table.column("segment"), "entry": pa.array([a for a, _ in ways], pa.int32()),
                "way": pa.array([4 * a + b for a, b in ways], pa.int32()), "cost": pa.array([cost] * len(rows)), "illegal": pa.array([illegal] * len(rows)),
            }
        )

    small = found.select("conv_id", "segment", "begin", "end", "illegal", "cost", "place")
    chosen = small.groupBy("conv_id").applyInArrow(combine, "conv_id long, segment long, entry int, way int, cost long, illegal long")
    chosen = chosen.toDF("_c", "_s", "entry", "way", "total", "all_illegal")
    audits = found.join(chosen, same(F.col("conv_id"), F.col("_c")) & (F.col("segment") == F.col("_s")))
    audits = save_and_read(audits.select("conv_id", "segment", "entry", F.get("audit", F.col("way")).alias("audit"), "total", "all_illegal"), "repair-audits")

    def rewrite(key, left: pa.Table, right: pa.Table) -> pa.Table:
        left, r = left.sort_by("at"), right.to_pylist()[0]
        lines = list(repaired_lines(left.column("role").to_pylist(), left.column("text").to_pylist(), r["audit"], r["entry"]))
        columns = {"conv_id": pa.array([r["conv_id"]], pa.int64()), "segment": [r["segment"]], "audit": [r["audit"]], "cost": [r["total"]], "illegal": [r["all_illegal"]]}
        return pa.table(columns | {"text": pa.array(["\n".join(lines) if lines else None], pa.string())})

    texts = numbered.select("conv_id", "segment", "at", "role", "text").groupBy("conv_id", "segment")
    pieces = texts.cogroup(audits.groupBy("conv_id", "segment")).applyInArrow(rewrite, "conv_id long, segment long, audit string, cost long, illegal long, text string")
    ordered = pieces.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "segment")

    def join_pieces(batches):
        at, state = None, None
        for batch in batches:
            for r in batch.to_pylist():
                if state is None or r["conv_id"] != at:
                    if state is not None:
                        yield finished(at, state)
                    at, state = r["conv_id"], {"audit": [], "cost": r["cost"], "illegal": r["illegal"], "hash": hashlib.sha256(), "some": False}
                state["audit"].append(r["audit"])
                if r["text"] is not None:
                    state["hash"].update((("\n" if state["some"] else "") + r["text"]).encode())
                    state["some"] = True
        if state is not None:
            yield finished(at, state)

    def finished(conv_id, state) -> dict:
        return {"_c": [conv_id], "cost": [state["cost"]], "illegal": [state["illegal"]], "audit": ["".join(state["audit"])], "repaired_sha256": [state["hash"].hexdigest()]}

    joined = map_partitions(ordered, "_c long, cost long, illegal long, audit string, repaired_sha256 string", join_pieces)
    return facts.join(joined, same(F.col("conv_id"), F.col("_c"))).select(*NAMES)


def repaired(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row for each ``conv_id`` of ``conversations`` (``conv_id, turn, role, text``): ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``."""
    rows = damaged(conversations)
    sizes = rows.groupBy(F.col("conv_id").alias("_c")).agg(F.sum("copies").alias("n"))
    large = save_and_read(sizes.where(F.col("n") > segment).select("_c"), "repair-large")
    if large.isEmpty():
        return _short(rows)
    inside = same(rows["conv_id"], large["_c"])
    return _short(rows.join(large, inside, "left_anti")).unionByName(_long(rows.join(large, inside, "left_semi"), segment))


def duckdb_sql() -> str:
    """The same rows by dynamic programming over places and states, instead of a search."""
    edits = """
  SELECT * FROM (VALUES (0, '', 0), (1, 'I', 3), (2, 'II', 6)) i(times, letters, price)
"""
    # an insertion leads from a state to the next one; two of them lead from start to 3
    moved = "CASE times WHEN 0 THEN s WHEN 1 THEN CASE s WHEN 2 THEN 3 ELSE 2 END ELSE CASE s WHEN 2 THEN 2 ELSE 3 END END"
    added = "CASE times WHEN 0 THEN [] WHEN 1 THEN [CASE s WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE CASE s WHEN 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END END"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)
), keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_transform(range(len(k)), lambda i: ord(k[i + 1 : i + 1])::BIGINT), lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]), 4294967295)) % 20 AS kind
  FROM keyed, crc
), rows AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM rows
), faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 0 WHEN seen > 1 THEN 1 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 2 ELSE 3 END AS fault,
    CASE role[1:1] WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial FROM numbered
), inserts AS ({edits}), best AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, 0 AS s, 0 AS cost, '' AS audit, []::VARCHAR[] AS lines FROM faults
  UNION ALL
  SELECT conv_id, i, s, cost, audit, lines FROM (
    SELECT conv_id, i, after AS s, cost + price AS cost, audit || letter AS audit, list_concat(lines, new) AS lines FROM (
      SELECT m.*, e.letter, f.i AS i,
        CASE e.letter WHEN 'D' THEN m.s WHEN 'K' THEN f.initial ELSE CASE m.s WHEN 2 THEN 3 ELSE 2 END END AS after,
        CASE e.letter WHEN 'D' THEN 4 WHEN 'K' THEN 0 ELSE 3 END + CASE WHEN e.letter <> 'D' AND f.fault = 2 THEN 3 ELSE 0 END AS price,
        CASE e.letter WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [CASE m.s WHEN 2 THEN 'assistant:' ELSE 'user:' END || f.text] END AS new
      FROM (SELECT conv_id, i AS before, {moved} AS s, cost + price AS cost, audit || letters AS audit, list_concat(lines, {added}) AS lines FROM best, inserts) m
      JOIN faults f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.i = m.before + 1
      JOIN (VALUES ('D'), ('K'), ('R')) e(letter) ON e.letter = 'D' OR f.fault >= 2
        AND (e.letter = 'R' OR f.initial = CASE m.s WHEN 2 THEN 3 ELSE 2 END OR f.initial = 1 AND m.s = 0)
    )
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1
), ends AS (
  SELECT conv_id, {moved} AS s, cost + price AS cost, audit || letters AS audit, list_concat(lines, {added}) AS lines
  FROM best, inserts WHERE (conv_id IS NULL, coalesce(conv_id, 0), i) IN (SELECT (conv_id IS NULL, coalesce(conv_id, 0), max(i)) FROM faults GROUP BY conv_id)
), found AS (
  SELECT * FROM ends WHERE s IN (0, 3) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1
), pairs AS (
  SELECT conv_id, initial * 4 + lead(initial) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM faults
), illegal AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE pair NOT IN (6, 11, 14) GROUP BY conv_id),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 0) AS blank, count(*) FILTER (fault = 1) AS duplicate,
    count(*) FILTER (fault = 2) AS truncated FROM faults GROUP BY conv_id
), every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM every e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN illegal g ON g.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN found h ON h.conv_id IS NOT DISTINCT FROM e.conv_id
"""
