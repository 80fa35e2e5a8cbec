"""Secret scans with corpus-wide ownership: who else has the same candidate?

Candidates are found in every whole text. Their values, as hashes, are counted over distinct repositories and owners of the whole corpus. A
value that many owners hold is a widely copied example; one that few owners hold and that looks random is a live-looking credential.

Kinds: ``assign`` (a value given to a password, secret, token or key name), ``access`` (access key ids), ``hex`` (long hexadecimal runs), and
``token`` (other long runs of letters and digits that look random), which the ownership counts add where no other kind was found and
few owners hold the value.

Defined results: null and empty texts have no candidates. Null owners and repositories count as one owner or repository named ''.
Rows repeating a ``doc_id`` are scanned one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import map_batches, save_and_read
from logspark.session import ship

KINDS = ("assign", "access", "hex", "token")
#: Fixed patterns. Key names match in either case.
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = re.compile(rf"""({NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{24,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
STEMS = ("passw", "secret", "token", "apikey", "api_key")
DUMMY = re.compile(r"example|sample|dummy|changeme|placeholder|xxxx|1234567|abcdef|your|test", re.IGNORECASE)
#: Bits a character of a live-looking value, and owners that may hold it.
ENTROPY = 2.5
OWNERS = 2


def entropy(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) if value else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """Kind, start, end and value of the base candidates: leftmost, not overlapping within a kind; in order of start, then kind."""
    found = []
    lowered = text.lower()
    if any(stem in lowered for stem in STEMS):
        found += [("assign", *m.span(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", *m.span(), m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    if HEX_RUN.search(text):
        found += [("hex", *m.span(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= LEAST["hex"]]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def more_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Random-looking runs outside the base spans."""
    out = []
    for m in TOKEN.finditer(text):
        start, end = m.span()
        digits, capitals = sum(c.isdigit() for c in m[0]), sum(c.isupper() for c in m[0])
        if digits >= 3 and digits + capitals < len(m[0]) and entropy(m[0]) >= 3.5 and all(end <= b[1] or start >= b[2] for b in base):
            out.append(("token", start, end, m[0]))
    return out


FOUND = "array<struct<kind:string,start:long,stop:long,value:string,random:boolean>>"


def candidate_spans(text: str | None) -> list[dict]:
    """``kind, start, stop, value`` (a digest) and ``random`` of every candidate of a text."""
    text, lowered = text or "", None
    if not any(len(w) >= 16 for w in text.split()) and not any(stem in (lowered := lowered or text.lower()) for stem in STEMS):
        return []
    base = base_spans(text)
    return [
        {"kind": k, "start": a, "stop": b, "value": hashlib.sha256(v.encode()).hexdigest(), "random": entropy(v) >= ENTROPY and not DUMMY.search(v)}
        for k, a, b, v in base + more_spans(text, base)
    ]


def candidates(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (``doc_id, text, owner, repository``) with ``found``: its candidates."""

    def scan(batch: pa.RecordBatch):
        found = [candidate_spans(text) for text in batch.column("text").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "owner": batch.column("owner"), "repository": batch.column("repository"), "found": found}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text", "owner", "repository"), f"doc_id long, owner string, repository string, found {FOUND}", scan)


def ownership(found: DataFrame) -> DataFrame:
    """``value, owners, repositories``: distinct holders of each candidate value in the corpus."""
    held = found.select("owner", "repository", F.explode("found.value").alias("value")).distinct()
    per_owner = held.groupBy("value", "owner").agg(F.count("*").alias("r"))
    return per_owner.groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "lang", max_owners: int = OWNERS) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs``: an array of ``start, stop, kind, value, owners, repositories, live``, ordered by
    start, then kind.

    A repository is a ``repository`` of an ``owner``. Base candidates all stay; of kind ``token`` only those that are live.
    """
    rows = docs.select("doc_id", "text", named(owner).alias("owner"), named(repository).alias("repository"))
    found = save_and_read(candidates(rows).withColumn("row", F.monotonically_increasing_id()), "secret-candidates")
    return found.select("row", "doc_id").join(row_spans(found, max_owners), "row", "left").select("doc_id", F.coalesce("spans", F.array()).alias("spans"))


def named(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_spans(found: DataFrame, max_owners: int) -> DataFrame:
    """``row, spans`` of every row of ``found`` (``row, owner, repository, found``) with a candidate."""
    each = found.select("row", F.explode("found").alias("f")).select("row", "f.*").join(ownership(found), "value")
    each = each.withColumn("live", F.col("random") & (F.col("owners") <= max_owners)).where("live or kind <> 'token'")
    order = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).alias("rank")
    span = F.struct("start", order, "stop", "kind", "value", "owners", "repositories", "live")
    return each.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("spans"))  # the spans of one text


def joined(spans, keep) -> F.Column:
    chosen = F.filter(spans, keep)
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """Counts and digests per row of :func:`secrets`."""
    count = lambda keep: F.size(F.filter("spans", keep)).cast("long")
    of = lambda kind: lambda s: s["kind"] == kind
    return found.select(
        "doc_id",
        *(count(of(k)).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(joined("spans", lambda s: s["kind"] != "token"), 256).alias("base_sha256"),
        joined("spans", lambda s: F.lit(True)).alias("spans"),
        count(lambda s: s["kind"] == "token").alias("n_token"),
        count(lambda s: s["live"]).alias("n_live"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", owner: str = "source", repository: str = "lang", max_owners: int = OWNERS) -> DataFrame:
    """``docs`` with every live-looking credential of each row replaced by ``mark``; all columns stay, ``n_chars`` follows the text.

    Texts are stored once, with their candidates; only rows that have some meet their spans, all others stay where they are.
    """

    @F.pandas_udf(FOUND)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(candidate_spans)

    ship(docs.sparkSession)
    rows = save_and_read(docs.withColumns({"__found": scan("text"), "__row": F.monotonically_increasing_id()}), "secret-rows")
    some = rows.where(F.size("__found") > 0)
    spans = row_spans(some.select(F.col("__row").alias("row"), named(owner).alias("owner"), named(repository).alias("repository"), F.col("__found").alias("found")), max_owners)
    live = spans.select(F.col("row").alias("__row"), F.filter("spans", lambda s: s["live"]).alias("__secret_spans")).where(F.size("__secret_spans") > 0)
    both = some.join(live, "__row", "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))

    def step(state, span):
        piece = F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.greatest(span["start"] - state["at"], F.lit(0)).cast("int"))
        return F.struct(
            F.when(span["start"] >= state["at"], F.concat(state["out"], piece, F.lit(mark))).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], span["stop"]).alias("at"),
        )

    def finish(state):
        return F.concat(state["out"], F.substring(F.col("text"), (state["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.col("__secret_spans").isNull(), F.col("text")).otherwise(F.aggregate("__secret_spans", start, step, finish))
    out = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__secret_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    rest = rows.where(F.size("__found") == 0)
    return rest.select(*docs.columns).unionByName(out.select(*docs.columns))
