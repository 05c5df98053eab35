"""Screening, redaction, routing, error classes and rewriting over the text tables."""

from pyspark.sql import functions as F

from docquery.operators import guardrails as G, rewrite as R, routing
from docquery.session import spread

from entries.tables import load, logs, register, WITH_LOGS

# DuckDB spells Unicode word edges out: its own \b and \d are ASCII only.
EDGE, END = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"
DIGITS = r"\d{3}-\d{2}-\d{4}|\d{10}|\d{9}"
PII_SQL = rf"{EDGE}(?:{DIGITS}){END}|[\p{{L}}\p{{N}}_]\(\d{{3}}\)\s*\d{{3}}-\d{{4}}{END}"
STRICT_SQL = rf"{EDGE}(?:{DIGITS}|\(\d{{3}}\)\s*\d{{3}}-\d{{4}}){END}"
EMAIL_SQL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"

# A policy whose words do occur in the invented prose.
CUSTOM = G.Policy(
    level="high",
    topics_by_level={"low": ["alpha"], "medium": ["alpha", "beta"], "high": ["alpha", "beta", "gamma"]},
    keywords={"alpha": ["tion", "zeit"], "beta": ["kill", "crime", "@"], "gamma": ["ssn", "phone"]},
    profane=["that", "und", "elle"], template=1)


def docs(spark, sf):
    return spread(load(spark, sf, "documents"), "doc_id")


def topics_sql(policy: G.Policy, text: str, prefix: str = "") -> str:
    cells = []
    for t in policy.topics():
        words = policy.keywords.get(t, [])
        test = " OR ".join(f"contains(lower({text}), '{w}')" for w in words) or "false"
        cells.append(f"CASE WHEN {test} THEN '{prefix}{t}' END")
    return f"list_filter([{', '.join(cells)}]::VARCHAR[], lambda x: x IS NOT NULL)"


def violations_sql(policy: G.Policy, text: str, messages) -> str:
    topic, pii, email, profanity = messages
    cells = [f"CASE WHEN regexp_matches({text}, '{PII_SQL}') THEN '{pii}' END",
             f"CASE WHEN regexp_matches({text}, '{EMAIL_SQL}') THEN '{email}' END"]
    if policy.profanity_active():
        cells.append(f"CASE WHEN regexp_matches({text}, '{profane_sql(policy)}') THEN '{profanity}' END")
    return (f"list_concat({topics_sql(policy, text, topic)}, "
            f"list_filter([{', '.join(cells)}]::VARCHAR[], lambda x: x IS NOT NULL))")


def profane_sql(policy: G.Policy) -> str:
    return rf"(?i){EDGE}(?:{'|'.join(policy.profane)}){END}"


def joined(c):
    return F.array_join(c, "; ")


@register("guard_topics", f"""
SELECT doc_id, array_to_string({topics_sql(G.Policy(level="high"), "text")}, '; ') AS topics,
       array_to_string({topics_sql(CUSTOM, "text")}, '; ') AS custom_topics FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", joined(G.topics_detected("text", G.Policy(level="high"))).alias("topics"),
        joined(G.topics_detected("text", CUSTOM)).alias("custom_topics"))


@register("guard_pii_legacy", f"SELECT doc_id, regexp_matches(text, '{PII_SQL}') AS pii FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", G.has_pii("text", G.Policy()).alias("pii"))


@register("guard_pii_strict", f"SELECT doc_id, regexp_matches(text, '{STRICT_SQL}') AS pii FROM documents")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", G.has_pii("text", G.Policy(pii=G.PII_STRICT)).alias("pii"))


@register("guard_email", f"SELECT doc_id, regexp_matches(text, '{EMAIL_SQL}') AS email FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", G.has_email("text", G.Policy()).alias("email"))


@register("guard_profanity", f"""
SELECT doc_id, regexp_matches(text, '{profane_sql(G.Policy())}') AS profane,
       regexp_matches(text, '{profane_sql(CUSTOM)}') AS custom_profane FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", G.has_profanity("text", G.Policy(level="high")).alias("profane"),
        G.has_profanity("text", CUSTOM).alias("custom_profane"))


PII_ANY = f"(regexp_matches(text, '{PII_SQL}') OR regexp_matches(text, '{EMAIL_SQL}'))"


@register("guard_input", f"""
SELECT doc_id, len(v) = 0 AS is_safe, array_to_string(v, '; ') AS violations, pii_detected, topics_detected
FROM (SELECT doc_id, {violations_sql(CUSTOM, "text", G.INPUT_MESSAGES)} AS v, {PII_ANY} AS pii_detected,
             array_to_string({topics_sql(CUSTOM, "text")}, '; ') AS topics_detected FROM documents)""")
def _(spark, sf):
    checked = docs(spark, sf).select("doc_id", G.check_input("text", CUSTOM).alias("c"))
    return checked.select("doc_id", "c.is_safe", joined("c.violations").alias("violations"), "c.pii_detected",
                          joined("c.topics_detected").alias("topics_detected"))


REDACT_PII = r"\b(?:\d{3}-\d{2}-\d{4}|\(\d{3}\)\s*\d{3}-\d{4}|\d{10}|\d{9})\b"


def redact_sql(text: str, profane: list[str] | None = None) -> str:
    out = (f"regexp_replace(regexp_replace({text}, '{REDACT_PII}', '[REDACTED PII]', 'g'), "
           f"'{EMAIL_SQL}', '[REDACTED EMAIL]', 'g')")
    if profane:
        # one word at a time: the edge in front is kept and the edge behind is not consumed by \b
        pattern = rf"({EDGE})(?:{'|'.join(profane)})\b"
        once = f"regexp_replace({out}, '(?i){pattern}', '\\1[REDACTED]', 'g')"
        out = once
    return out


@register("redact_text", f"SELECT doc_id, {redact_sql('text')} AS redacted FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", G.redact("text").alias("redacted"))


MEDIUM = G.Policy(topics_by_level={"medium": ["alpha", "beta"]}, keywords={"alpha": ["zeit"], "beta": ["kill", "crime", "rrr"]},
                  template=1)


@register("guard_output", f"""
SELECT doc_id, len(v) = 0 AS is_safe, array_to_string(v, '; ') AS violations,
       CASE WHEN len(t) > 0 THEN 'I''m not able to assist with ' || t[1] || '.' ELSE redacted END AS safe_response
FROM (SELECT doc_id, {violations_sql(MEDIUM, "text", G.OUTPUT_MESSAGES)} AS v, {topics_sql(MEDIUM, "text")} AS t,
             {redact_sql('text')} AS redacted FROM documents)""")
def _(spark, sf):
    checked = docs(spark, sf).select("doc_id", G.check_output("text", MEDIUM).alias("c"))
    return checked.select("doc_id", "c.is_safe", joined("c.violations").alias("violations"), "c.safe_response")


PAIRS = """pairs AS (SELECT conv_id, turn, text AS query, n_text AS response FROM (
  SELECT *, lead(role) OVER w AS n_role, lead(text) OVER w AS n_text FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND n_role = 'assistant')"""


def pairs(spark, sf):
    from docquery.operators.sessions import pair_turns

    return pair_turns(load(spark, sf, "conversations"))


APPLY = G.Policy(topics_by_level={"medium": ["alpha", "beta"]},
                 keywords={"alpha": ["heon", "zeit"], "beta": ["leau", "tion"]}, template=0)


@register("guard_apply", f"""WITH {PAIRS},
c AS (SELECT *, {violations_sql(APPLY, "query", G.INPUT_MESSAGES)} AS vi,
             {violations_sql(APPLY, "response", G.OUTPUT_MESSAGES)} AS vo, {topics_sql(APPLY, "response")} AS t,
             {redact_sql("response")} AS redacted FROM pairs)
SELECT conv_id, turn, len(vi) = 0 AND len(vo) = 0 AS is_safe, array_to_string(vi, '; ') AS input_violations,
  CASE WHEN len(vi) > 0 THEN 'Blocked due to unsafe input' ELSE array_to_string(vo, '; ') END AS output_violations,
  CASE WHEN len(vi) > 0 THEN 'I cannot provide information about that request.'
       WHEN len(t) > 0 THEN 'I cannot provide information about ' || t[1] || '.' ELSE redacted END AS safe_response
FROM c""")
def _(spark, sf):
    out = G.apply_guardrails(pairs(spark, sf), "query", "response", APPLY)
    return out.select("conv_id", "turn", "is_safe", joined("input_check.violations").alias("input_violations"),
                      joined("output_check.violations").alias("output_violations"), "safe_response")


@register("guard_block_split", f"""
SELECT conv_id, turn, CASE WHEN len(v) > 0 THEN 'blocked' ELSE 'open' END AS status,
  CASE WHEN len(v) > 0 THEN 'I''m sorry, I cannot respond to that query as it violates content policies.' END AS response
FROM (SELECT conv_id, turn, {violations_sql(APPLY, "text", G.INPUT_MESSAGES)} AS v FROM conversations)""")
def _(spark, sf):
    safe, blocked = G.split_blocked(load(spark, sf, "conversations"), "text", APPLY)
    opened = safe.select("conv_id", "turn", F.lit("open").alias("status"), F.lit(None).cast("string").alias("response"))
    return opened.unionByName(blocked.select("conv_id", "turn", "status", "response"))


# Whole documents as questions, most with a route word put in front.
ROUTED = """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'Show the DOCUMENT ' WHEN 1 THEN 'sales report ' WHEN 2 THEN 'an article on data '
  WHEN 3 THEN 'CUSTOMER ' WHEN 4 THEN 'database ' ELSE '' END || text AS query FROM documents"""


@register("route_query", f"""
SELECT doc_id, CASE WHEN contains(lower(query), 'document') OR contains(lower(query), 'article') OR contains(lower(query), 'content') THEN 'RAG'
  WHEN contains(lower(query), 'data') OR contains(lower(query), 'report') OR contains(lower(query), 'sales')
    OR contains(lower(query), 'customer') OR contains(lower(query), 'product') OR contains(lower(query), 'order')
    OR contains(lower(query), 'revenue') THEN 'SQL' ELSE 'AGENT' END AS route FROM ({ROUTED})""")
def _(spark, sf):
    m = F.col("doc_id") % 7
    lead = (F.when(m == 0, "Show the DOCUMENT ").when(m == 1, "sales report ").when(m == 2, "an article on data ")
            .when(m == 3, "CUSTOMER ").when(m == 4, "database ").otherwise(""))
    asked = docs(spark, sf).select(
        "doc_id", F.concat(lead, "text").alias("query"))
    return asked.select("doc_id", routing.route("query").alias("route"))


@register("classify_error", WITH_LOGS + """,
m AS (SELECT request_id, CASE event WHEN 0 THEN 'Endpoint ' WHEN 1 THEN 'vector ' WHEN 2 THEN 'SQL ' WHEN 3 THEN 'Model inference '
   ELSE '' END || CASE WHEN event % 2 = 0 THEN response ELSE query END AS message
   FROM (SELECT *, user_id::BIGINT % 6 AS event FROM logs))
SELECT request_id, CASE WHEN contains(lower(message), 'model inference') OR contains(lower(message), 'endpoint') THEN 'MODEL_INFERENCE'
  WHEN contains(lower(message), 'retriev') OR contains(lower(message), 'vector') OR contains(lower(message), 'embedding') THEN 'RETRIEVAL'
  WHEN contains(lower(message), 'sql') OR contains(lower(message), 'database') OR contains(lower(message), 'query') THEN 'DATABASE'
  ELSE 'GENERAL' END AS error_type FROM m""")
def _(spark, sf):
    e = F.col("user_id").cast("bigint") % 6
    lead = (F.when(e == 0, "Endpoint ").when(e == 1, "vector ").when(e == 2, "SQL ").when(e == 3, "Model inference ")
            .otherwise(""))
    body = F.when(e % 2 == 0, F.col("response")).otherwise(F.col("query"))
    return logs(spark, sf).select("request_id", F.concat(lead, body).alias("message")).select(
        "request_id", routing.classify_error("message").alias("error_type"))


@register("blank_query", """
SELECT conv_id, turn, CASE WHEN q = '' THEN 'Please provide a valid query.' ELSE q END AS answer
FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS q FROM conversations)""")
def _(spark, sf):
    c = load(spark, sf, "conversations").withColumn("q", F.when(F.col("role") == "system", "").otherwise(F.col("text")))
    return c.select("conv_id", "turn", routing.or_fixed_message("q", F.col("q")).alias("answer"))


@register("rewrite_bypass", """
SELECT conv_id, turn, text AS original_query, len(w) > 2 AS rewritten,
       CASE WHEN len(w) > 2 THEN array_to_string(list_transform(w, lambda x: lower(x)), ' ') ELSE text END AS rewritten_query
FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)""")
def _(spark, sf):
    from docquery.functions.text import words

    c = load(spark, sf, "conversations")
    out = R.rewrite_queries(c, "text", F.array_join(F.transform(words("text"), F.lower), " "))
    return out.select("conv_id", "turn", "original_query", "rewritten_query", "rewritten")


@register("rewrite_expand", """
SELECT conv_id, turn, CASE WHEN len(w) > 2 THEN trim(array_to_string(list_transform(
    list_filter(w, lambda x: lower(x) NOT IN ('the', 'of', 'le', 'la')),
    lambda x: CASE lower(x) WHEN 'that' THEN 'that OR which' WHEN 'is' THEN 'is OR are' WHEN 'er' THEN 'emergency room' ELSE x END), ' '))
  ELSE text END AS rewritten_query
FROM (SELECT *, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM conversations)""")
def _(spark, sf):
    rule = R.expand("text", {"er": "emergency room"}, {"that": "which", "is": "are"}, ["the", "of", "le", "la"])
    out = R.rewrite_queries(load(spark, sf, "conversations"), "text", rule)
    return out.select("conv_id", "turn", "rewritten_query")


# The generated text stands for a model's answer: a document's lines, every second one numbered.
@register("variant_parse", r"""
WITH g AS (SELECT doc_id, lang AS query,
    array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
       CASE i % 3 WHEN 0 THEN x WHEN 1 THEN i || '. ' || x ELSE i || ') ' || x END), chr(10)) AS generated FROM documents),
l AS (SELECT *, string_split(regexp_replace(generated, '^\s+|\s+$', '', 'g'), chr(10)) AS lines FROM g),
p AS (SELECT *, list_filter(list_transform(list_filter(lines, lambda x: regexp_matches(x, '\d')),
        lambda x: regexp_replace(regexp_replace(regexp_replace(x, '(?s)^[^.]*\.', ''), '(?s)^[^)]*\)', ''), '^\s+|\s+$', '', 'g')),
        lambda x: x <> '') AS parsed FROM l)
SELECT doc_id, array_to_string(list_concat([query], (CASE WHEN len(parsed) > 0 THEN parsed ELSE
   list_filter(list_transform(lines, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END)[1:2]), ' | ') AS variants
FROM p""")
def _(spark, sf):
    n = lambda i: (i + 1).cast("string")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.when((i + 1) % 3 == 0, x).when(
        (i + 1) % 3 == 1, F.concat(n(i), F.lit(". "), x)).otherwise(F.concat(n(i), F.lit(") "), x)))
    d = docs(spark, sf).select("doc_id", F.col("lang").alias("query"),
                                            F.array_join(lines, "\n").alias("generated"))
    return d.select("doc_id", F.array_join(R.parse_variants("query", "generated", 3), " | ").alias("variants"))
