"""Projections, scalar functions and predicates (P and F rows), and line sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Tables, oracle, query
from logspark.functions import reports, rules, text
from logspark.sources import lines as sources

SPLIT = "regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\r\\n|\\n|\\r')"
DOC_LINES = f"""SELECT doc_id, CAST(unnest(range(len({SPLIT}))) AS BIGINT) AS line_no, unnest({SPLIT}) AS line
  FROM documents WHERE regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> ''"""


@query("read_log_lines", oracle("SELECT * FROM doc_lines", doc_lines=DOC_LINES))
def read_log_lines(t: Tables):
    return sources.lines_of_text(t.documents, ["doc_id"])


@query("truncate_text", "SELECT doc_id, substr(text, 1, 1024) AS truncated FROM documents")
def truncate_text(t: Tables):
    return t.documents.select("doc_id", text.truncate_text(F.col("text")).alias("truncated"))


@query(
    "normalize_log_line",
    oracle("SELECT event_id, line FROM lines", "lines"),
)
def normalize_log_line(t: Tables):
    escape = F.lit("\u001b")
    coloured = F.concat(F.lit("  "), escape, F.lit("[1;31m"), "line", escape, F.lit("[0m"), escape, F.lit("M \t"))
    return t.lines().select("event_id", text.normalize_log_line(coloured).alias("line"))


@query(
    "extract_timestamp",
    oracle(
        "SELECT event_id, nullif(regexp_extract(line, '[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}'), '') AS stamp FROM x",
        "log_events",
        "lines",
        x="SELECT event_id, line FROM lines UNION ALL SELECT -1 - event_id, message FROM log_events",
    ),
)
def extract_timestamp(t: Tables):
    bare = t.log_events().select((-1 - F.col("event_id")).alias("event_id"), F.col("message").alias("line"))
    both = t.lines().select("event_id", "line").union(bare)
    return both.select("event_id", text.extract_timestamp(F.col("line")).alias("stamp"))


LEVEL = "CASE " + " ".join(f"WHEN contains(upper(line), '{x}') THEN '{x}'" for x in text.LEVELS) + " END"


@query(
    "extract_level",
    oracle(
        f"SELECT event_id, {LEVEL} AS level FROM x",
        "log_events",
        x="SELECT event_id, replace(message, 'INFO user', 'warn user') AS line FROM log_events",
    ),
)
def extract_level(t: Tables):
    line = F.replace("message", F.lit("INFO user"), F.lit("warn user"))
    return t.log_events().select("event_id", text.extract_level(line).alias("level"))


@query(
    "format_log_line",
    oracle(
        """SELECT event_id, strftime(ms, '%Y-%m-%dT%H:%M:%S')
             || CASE WHEN epoch_us(ms) % 1000000 = 0 THEN '' ELSE strftime(ms, '.%f') END || '+00:00 ' || message AS line
           FROM (SELECT *, make_timestamp_ms(epoch_us(ts) // 1000) AS ms FROM log_events)""",
        "log_events",
    ),
)
def format_log_line(t: Tables):
    raw = F.concat("message", F.lit("\n\n"))
    return t.log_events().select("event_id", text.format_log_line(F.unix_millis("ts"), raw).alias("line"))


@query(
    "to_snake_case",
    """SELECT p_partkey, lower(regexp_replace(regexp_replace(n, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'),
         '([a-z0-9])([A-Z])', '\\1_\\2', 'g')) AS operation
       FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Describe' WHEN 1 THEN 'get' ELSE 'listDB' END
         || replace(p_brand, '#', '') || p_type AS n FROM part)""",
)
def to_snake_case(t: Tables):
    verb = F.when(F.col("p_partkey") % 3 == 0, "Describe").when(F.col("p_partkey") % 3 == 1, "get").otherwise("listDB")
    name = F.concat(verb, F.replace("p_brand", F.lit("#"), F.lit("")), "p_type")
    return t.part.select("p_partkey", text.to_snake_case(name).alias("operation"))


RCA_LINES = "list_transform(regexp_split_to_array(rca, '\\n'), lambda x: trim(x))"


@query(
    "rca_severity",
    oracle(
        """SELECT incident_id, coalesce(upper(s[1]) || lower(substr(s, 2)), 'Unknown') AS severity FROM (
             SELECT incident_id, list_filter(list_transform(list_filter(l, lambda x: starts_with(upper(x), 'STATUS:')),
               lambda x: trim(replace(upper(x), 'STATUS:', ''))),
               lambda x: x IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'HEALTHY'))[1] AS s FROM x)""",
        "incidents",
        x=f"SELECT incident_id, {RCA_LINES} AS l FROM incidents",
    ),
)
def rca_severity(t: Tables):
    return t.incidents().select("incident_id", reports.rca_severity(F.col("rca")).alias("severity"))


HEALTHY = (
    "len(list_filter(l, lambda x: starts_with(upper(x), 'STATUS:') AND contains(upper(x), 'HEALTHY'))) > 0"
)


@query(
    "rca_is_healthy",
    oracle(f"SELECT incident_id, {HEALTHY} AS healthy FROM x", "incidents", x=f"SELECT incident_id, {RCA_LINES} AS l FROM incidents"),
)
def rca_is_healthy(t: Tables):
    return t.incidents().select("incident_id", reports.rca_is_healthy(F.col("rca")).alias("healthy"))


@query(
    "rca_spoken_summary",
    oracle(
        f"""SELECT incident_id, coalesce(
              trim(substr(list_filter(l, lambda x: starts_with(x, 'SPOKEN SUMMARY:'))[1], 16)),
              trim(substr(list_filter(l, lambda x: starts_with(x, 'SUMMARY:'))[1], 9)), '{reports.NO_SUMMARY}') AS spoken FROM x""",
        "incidents",
        x=f"SELECT incident_id, {RCA_LINES} AS l FROM incidents",
    ),
)
def rca_spoken_summary(t: Tables):
    return t.incidents().select("incident_id", reports.rca_spoken_summary(F.col("rca")).alias("spoken"))


RESOURCES = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN 'orders-DB-' WHEN 2 THEN 'Lambda-' WHEN 3 THEN 'instance/'
  WHEN 4 THEN 'Container-' WHEN 5 THEN 'gateway-' WHEN 6 THEN 'LoadBalancer-' WHEN 7 THEN 'user service ' ELSE 'x-' END
  || CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS resource FROM part"""


def _hit(parts):
    return "(" + " OR ".join(f"contains(lower(resource), '{p}')" for p in parts) + ")"


NAMESPACE_SQL = (
    "CASE " + " ".join(f"WHEN {_hit(p)} THEN '{n}'" for p, n in reports.NAMESPACES) + f" ELSE '{reports.DEFAULT_NAMESPACE}' END"
)
DIMENSION_SQL = (
    "CASE WHEN resource = '' THEN NULL "
    + " ".join(f"WHEN {_hit(p)} THEN '{n}'" for p, n in reports.DIMENSIONS)
    + f" ELSE '{reports.DEFAULT_DIMENSION}' END"
)


@query("guess_namespace", oracle(f"SELECT p_partkey, {NAMESPACE_SQL} AS namespace FROM r", r=RESOURCES))
def guess_namespace(t: Tables):
    return t.sql(RESOURCES, "part").select("p_partkey", reports.guess_namespace(F.col("resource")).alias("namespace"))


@query(
    "guess_dimensions",
    oracle(
        f"SELECT p_partkey, {DIMENSION_SQL} AS name, CASE WHEN resource = '' THEN NULL ELSE resource END AS value FROM r",
        r=RESOURCES,
    ),
)
def guess_dimensions(t: Tables):
    pair = F.get(F.map_entries("d"), F.lit(0))
    return (
        t.sql(RESOURCES, "part")
        .select("p_partkey", reports.guess_dimensions(F.col("resource")).alias("d"))
        .select("p_partkey", pair["key"].alias("name"), pair["value"].alias("value"))
    )


CONTEXT_SQL = """concat_ws(chr(10), 'Trigger type: ' || trigger_type,
  CASE WHEN alarm_name <> '' THEN 'Alarm: ' || alarm_name END,
  CASE WHEN alarm_reason <> '' THEN 'Reason: ' || alarm_reason END,
  CASE WHEN trigger_type = 'schedule' THEN 'This is a scheduled scan, not triggered by a specific alarm.' END)"""


@query("trigger_context", oracle(f"SELECT incident_id, {CONTEXT_SQL} AS context FROM incidents", "incidents"))
def trigger_context(t: Tables):
    context = reports.trigger_context(F.col("trigger_type"), F.col("alarm_name"), F.col("alarm_reason"))
    return t.incidents().select("incident_id", context.alias("context"))


@query("estimate_tokens", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def estimate_tokens(t: Tables):
    return t.documents.select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(
    "section_label",
    """SELECT l_orderkey, l_linenumber, '[/app/' || l_suppkey || ']' || CASE WHEN l_returnflag = 'R'
         THEN ' (reduced to top ' || CAST(round_even(CAST(l_quantity AS DECIMAL(20, 10)) / 8 * 10, 0) AS BIGINT) || '%)'
         ELSE ' (full logs)' END AS label FROM lineitem""",
)
def section_label(t: Tables):
    share = F.col("l_quantity").cast("decimal(20,10)") / 80
    group = F.concat(F.lit("/app/"), "l_suppkey")
    label = reports.section_label(group, F.col("l_returnflag") == "R", share)
    return t.lineitem.select("l_orderkey", "l_linenumber", label.alias("label"))


REPLIES = """SELECT o_orderkey, CASE o_orderkey % 6
  WHEN 0 THEN concat('```json', chr(10), j, chr(10), '```') WHEN 1 THEN concat('```', chr(10), j, '```')
  WHEN 2 THEN concat('  ', j, chr(10)) WHEN 3 THEN 'no json at all' WHEN 4 THEN replace(j, '"severity": ', '"level": ') ELSE j END AS raw,
  concat(CASE o_orderstatus WHEN 'F' THEN 'worker killed by oom ' WHEN 'O' THEN 'Connection refused ' ELSE 'all quiet ' END, o_custkey) AS log_text
FROM (SELECT *, concat('{"severity": "', CASE o_orderstatus WHEN 'F' THEN 'CRITICAL' WHEN 'O' THEN 'HIGH' ELSE 'odd' END,
  '", "root_cause": "order ', o_orderkey, '"', CASE WHEN o_orderkey % 4 = 0 THEN ''
  ELSE concat(', "evidence": ["', o_orderpriority, '", "b"], "confidence": 0.', o_orderkey % 9 + 1) END, '}') AS j FROM orders)"""


@query(
    "parse_model_response",
    oracle(
        """SELECT o_orderkey, coalesce(sev, CASE WHEN contains(t, 'oom') OR contains(t, 'killed') THEN 'CRITICAL'
               WHEN contains(t, 'connection refused') THEN 'HIGH' ELSE 'WARNING' END) AS severity,
             CASE WHEN sev IS NULL THEN CASE WHEN contains(t, 'oom') THEN 'out of memory'
               WHEN contains(t, 'connection refused') THEN 'network failure' ELSE 'Unknown error detected' END
               ELSE json_extract_string(c, '$.root_cause') END AS root_cause,
             CASE WHEN sev IS NULL THEN 0 ELSE coalesce(json_array_length(c, '$.evidence'), 0) END::BIGINT AS evidence,
             CASE WHEN sev IS NULL THEN CASE WHEN contains(t, 'oom') THEN 0.7 WHEN contains(t, 'connection refused') THEN 0.65 ELSE 0.5 END
               ELSE coalesce(CAST(json_extract_string(c, '$.confidence') AS DOUBLE), 0.5) END::DOUBLE AS confidence
           FROM (SELECT *, lower(log_text) AS t, CASE WHEN json_extract_string(c, '$.severity') IN ('INFO', 'WARNING', 'HIGH', 'CRITICAL')
             THEN json_extract_string(c, '$.severity') END AS sev FROM v)""",
        r=REPLIES,
        s="SELECT *, trim(replace(replace(trim(raw, ' ' || chr(10)), '```json', ''), '```', ''), ' ' || chr(10)) AS c0 FROM r",
        v="SELECT *, CASE WHEN json_valid(c0) THEN c0 ELSE '{}' END AS c FROM s",
    ),
)
def parse_model_response(t: Tables):
    cause = rules.rule_root_cause(F.col("log_text"))
    empty = F.array().cast("array<string>")
    fallback = F.struct(
        cause["severity"].alias("severity"),
        cause["root_cause"].alias("root_cause"),
        empty.alias("affected_components"),
        empty.alias("evidence"),
        cause["next_steps"].alias("next_steps"),
        cause["confidence"].alias("confidence"),
    )
    report = reports.parse_report(F.col("raw"), fallback)
    return t.sql(REPLIES, "orders").select("o_orderkey", report.alias("r")).select(
        "o_orderkey", "r.severity", "r.root_cause", F.size("r.evidence").cast("bigint").alias("evidence"), "r.confidence"
    )


@query(
    "infer_severity",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' AND l_linestatus <> 'O' THEN 'INFO'
         WHEN l_returnflag <> 'R' THEN 'WARNING' WHEN l_linenumber = 3 OR l_discount * 10 < 0.8 THEN 'HIGH' ELSE 'CRITICAL' END AS severity
       FROM lineitem""",
)
def infer_severity(t: Tables):
    confidence = F.when(F.col("l_linenumber") != 3, F.col("l_discount") * 10)
    severity = reports.infer_severity(F.col("l_returnflag") == "R", F.col("l_linestatus") == "O", confidence)
    return t.lineitem.select("l_orderkey", "l_linenumber", severity.alias("severity"))


@query(
    "merge_maps",
    """SELECT l_orderkey, l_linenumber, l_returnflag AS flag, CASE WHEN l_linenumber % 2 = 0 THEN 'right' ELSE 'left' END AS side,
         CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate::DATE::VARCHAR END AS extra FROM lineitem""",
)
def merge_maps(t: Tables):
    left = F.create_map(F.lit("side"), F.lit("left"), F.lit("flag"), F.col("l_returnflag"))
    right = F.when(
        F.col("l_linenumber") % 2 == 0,
        F.create_map(F.lit("side"), F.lit("right"), F.lit("extra"), F.to_date("l_shipdate").cast("string")),
    ).otherwise(F.create_map().cast("map<string,string>"))
    merged = t.lineitem.select("l_orderkey", "l_linenumber", text.merge_maps(left, right).alias("m"))
    return merged.select("l_orderkey", "l_linenumber", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("flag", "side", "extra")])


@query(
    "structured_log_json",
    oracle(
        """SELECT event_id, '{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '","level":"' || split_part(message, ' ', 1)
             || '","logger":"' || log_group || '","message":"' || message || '"'
             || CASE WHEN contains(message, 'exception') THEN ',"exception":"value ' || CAST(floor(value) AS INT) || '"' ELSE '' END || '}' AS record,
             split_part(message, ' ', 1) AS level
           FROM log_events""",
        "log_events",
    ),
)
def structured_log_json(t: Tables):
    level = F.split_part("message", F.lit(" "), F.lit(1))
    cause = F.when(F.col("message").contains("exception"), F.concat(F.lit("value "), F.floor("value").cast("int").cast("string")))
    record = text.structured_log_json(F.col("ts"), level, F.col("log_group"), F.col("message"), cause)
    back = F.from_json("record", text.STRUCTURED_LOG)["level"].alias("level")
    return t.log_events().select("event_id", record.alias("record")).select("event_id", "record", back)


SLOTS = """SELECT p_partkey, concat('{"metric": ', CASE WHEN p_partkey % 4 = 0 THEN 'null' ELSE concat('{"value": {"interpretedValue": "', p_type, '"}}') END,
  ', "resource": {"value": {"interpretedValue": "', p_brand, '"}}, "other": {"value": null}}') AS slots FROM part"""


@query(
    "slot_text",
    oracle(
        """SELECT p_partkey, lower(concat_ws(' ', m, r)) AS words, coalesce(m, '') AS metric FROM (
             SELECT p_partkey, json_extract_string(slots, '$.metric.value.interpretedValue') AS m,
               json_extract_string(slots, '$.resource.value.interpretedValue') AS r FROM s)""",
        s=SLOTS,
    ),
)
def slot_text(t: Tables):
    slots = F.col("slots")
    return t.sql(SLOTS, "part").select(
        "p_partkey", reports.slot_text(slots).alias("words"), reports.slot_value(slots, "metric").alias("metric")
    )


@query(
    "cap_list_fields",
    """SELECT doc_id, array_to_string(list_slice(w, 1, 20), ' ') AS first_words, CAST(least(len(w), 20) AS BIGINT) AS n
       FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""",
)
def cap_list_fields(t: Tables):
    return t.documents.select("doc_id", text.cap_list(F.split("text", " ")).alias("w")).select(
        "doc_id", F.array_join("w", " ").alias("first_words"), F.size("w").cast("bigint").alias("n")
    )


@query("content_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(t: Tables):
    return t.documents.select("doc_id", text.content_hash(F.col("text")).alias("hash"))


@query(
    "filter_pattern",
    oracle(
        """SELECT event_id, pattern FROM log_events, (VALUES ('ERROR'), ('ERROR connection'), ('?ERROR ?FATAL ?CRITICAL'), ('')) p(pattern)
           WHERE CASE pattern WHEN 'ERROR' THEN contains(message, 'ERROR')
             WHEN 'ERROR connection' THEN contains(message, 'ERROR') AND contains(message, 'connection')
             WHEN '' THEN true ELSE contains(message, 'ERROR') OR contains(message, 'FATAL') OR contains(message, 'CRITICAL') END""",
        "log_events",
    ),
)
def filter_pattern(t: Tables):
    patterns = ("ERROR", "ERROR connection", "?ERROR ?FATAL ?CRITICAL", "")
    hits = F.array_compact(
        F.array(*[F.when(rules.filter_pattern(F.col("message"), p), F.lit(p)) for p in patterns])
    )
    return t.log_events().select("event_id", F.explode(hits).alias("pattern"))


@query(
    "readonly_operation",
    """SELECT p_partkey, starts_with(n, 'describe_') OR starts_with(n, 'get_') OR starts_with(n, 'list_') AS allowed
       FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'describe_' WHEN 1 THEN 'get_' WHEN 2 THEN 'list_' ELSE 'delete_' END || 'parts' AS n FROM part)""",
)
def readonly_operation(t: Tables):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "DescribeParts").when(k == 1, "getParts").when(k == 2, "list_parts").otherwise("DeleteParts")
    return t.part.select("p_partkey", rules.is_read_only(text.to_snake_case(name)).alias("allowed"))


@query(
    "notify_gate",
    oracle(
        f"SELECT incident_id FROM x WHERE NOT ({HEALTHY} AND trigger_type = 'schedule')",
        "incidents",
        x=f"SELECT incident_id, trigger_type, {RCA_LINES} AS l FROM incidents",
    ),
)
def notify_gate(t: Tables):
    quiet = reports.rca_is_healthy(F.col("rca")) & (F.col("trigger_type") == "schedule")
    return t.incidents().filter(~quiet).select("incident_id")
