"""Edge rows worked out by hand, and properties."""

import pytest
from pyspark.sql import functions as F

from docquery.operators import guardrails as G, routing

ROWS = ["skill", " (743) 555-3824", "x(743) 555-3824", "123-45-6789", "12345678", "123456789", "1234567890",
        "12345678901", "a@b.co", "damn it", "hello", "Hell", "éass", "ass", "kill 123456789 a@b.co crime", "", None,
        "١٢٣٤٥٦٧٨٩"]


def check(spark, fn, rows=ROWS):
    df = spark.createDataFrame(list(enumerate(rows)), "i int, t string")
    return [r.c for r in df.select("i", fn.alias("c")).orderBy("i").collect()]


NUMBER, MAIL = "PII detected: Possible SSN or phone number", "PII detected: Email address"
CRIME, VIOLENCE, PROFANE = "Banned topic: illegal activities", "Banned topic: violence", "Profanity detected"
FOUND_ANYWHERE = {
    "x(743) 555-3824": [NUMBER], "123-45-6789": [NUMBER], "123456789": [NUMBER], "1234567890": [NUMBER],
    "a@b.co": [MAIL], "١٢٣٤٥٦٧٨٩": [NUMBER], "kill 123456789 a@b.co crime": [NUMBER, MAIL],
}
FOUND_BY_LEVEL = {
    "low": {"kill 123456789 a@b.co crime": [CRIME, NUMBER, MAIL]},
    "medium": {"skill": [VIOLENCE], "kill 123456789 a@b.co crime": [CRIME, VIOLENCE, NUMBER, MAIL]},
    "high": {"skill": [VIOLENCE], "kill 123456789 a@b.co crime": [CRIME, VIOLENCE, NUMBER, MAIL],
             "damn it": [PROFANE], "Hell": [PROFANE], "ass": [PROFANE]},
    "unknown": {},
}


@pytest.mark.parametrize("level", FOUND_BY_LEVEL)
def test_input_check(spark, level):
    expected = FOUND_ANYWHERE | FOUND_BY_LEVEL[level]
    for text, c in zip(ROWS, check(spark, G.check_input("t", G.Policy(), level))):
        found = expected.get(text, [])
        assert c.violations == found, text
        assert c.is_safe == (not found)
        assert c.pii_detected == (NUMBER in found or MAIL in found)
        assert c.topics_detected == [v.removeprefix("Banned topic: ") for v in found if v in (CRIME, VIOLENCE)]


def test_bracketed_phone_needs_the_strict_pattern(spark):
    legacy = check(spark, G.has_pii("t", G.Policy()))
    strict = check(spark, G.has_pii("t", G.Policy(pii=G.PII_STRICT)))
    assert (legacy[1], strict[1]) == (False, True)
    assert (legacy[2], strict[2]) == (True, False)


def test_whole_word_topics(spark):
    assert check(spark, G.topics_detected("t", G.Policy(whole_word=True)), ["skill", "a kill b"]) == [[], ["violence"]]


def test_redaction_is_idempotent(spark):
    once = G.redact("t", G.Policy(), "high")
    df = spark.createDataFrame([(t,) for t in ROWS if t], "t string").select(once.alias("t"))
    twice = df.select("t", G.redact("t", G.Policy(), "high").alias("again")).collect()
    assert all(r.t == r.again for r in twice)
    assert "[REDACTED] it" in [r.t for r in twice]


def test_apply(spark):
    df = spark.createDataFrame([("hi", "fine"), ("hack", "fine"), ("hi", "kill 123456789"), ("hi", "mail a@b.co")],
                               "q string, r string")
    rows = {(r.q, r.r): r for r in G.apply_guardrails(df, "q", "r", G.Policy(template=0)).collect()}
    assert rows[("hi", "fine")].safe_response == "fine" and rows[("hi", "fine")].is_safe
    blocked = rows[("hack", "fine")]
    assert blocked.safe_response == "I cannot provide information about that request."
    assert blocked.output_check.violations == ["Blocked due to unsafe input"] and not blocked.is_safe
    assert rows[("hi", "kill 123456789")].safe_response == "I cannot provide information about violence."
    assert rows[("hi", "mail a@b.co")].safe_response == "mail [REDACTED EMAIL]"


def test_template_by_hash_is_stable(spark):
    a = check(spark, G.check_output("t"), ["kill", "weapon"])
    assert a == check(spark, G.check_output("t"), ["kill", "weapon"])
    options = {t.format(topic="violence") for t in G.TEMPLATES}
    assert {x.safe_response for x in a} <= options


def test_split_keeps_every_row(spark):
    df = spark.createDataFrame([(t,) for t in ROWS], "q string")
    safe, blocked = G.split_blocked(df, "q")
    assert safe.count() + blocked.count() == len(ROWS)
    assert {r.status for r in blocked.collect()} == {"blocked"}


def test_routes_and_errors(spark):
    assert check(spark, routing.route("t"), ["sales document", "CUSTOMER", "hello", "database", "Article"]) == [
        "RAG", "SQL", "AGENT", "SQL", "RAG"]
    messages = ["endpoint query failed", "vector sql", "bad Query", "other", "Retrieval failed"]
    want = ["MODEL_INFERENCE", "RETRIEVAL", "DATABASE", "GENERAL", "RETRIEVAL"]
    assert check(spark, routing.classify_error("t"), messages) == want
    assert [routing.classify_error_text(m) for m in messages] == want


def test_error_predicates_differ(spark):
    rows = ["Error: x", "an error", "sorry", None]
    assert check(spark, routing.response_type("t"), rows) == ["Success", "Error", "Apology", "Success"]
    assert check(spark, routing.is_prefixed_error("t"), rows) == [True, False, False, None]
    assert check(spark, routing.mentions_error("t"), rows) == [False, True, False, None]


def test_blank_question(spark):
    assert check(spark, routing.or_fixed_message("t", F.col("t")), ["", "x", None]) == [
        "Please provide a valid query.", "x", "Please provide a valid query."]
