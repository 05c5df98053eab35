"""Screening and redaction as column expressions: no shuffle, no Python."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

# Topics screened per level, in reporting order.
TOPICS_BY_LEVEL = {
    "low": ["illegal activities"],
    "medium": ["illegal activities", "adult content", "violence"],
    "high": ["illegal activities", "adult content", "violence", "political extremism", "discrimination",
             "personal attacks"],
}
# Keywords per topic.
TOPIC_KEYWORDS = {
    "illegal activities": ["hack", "steal", "illegal", "crime", "criminal"],
    "adult content": ["adult", "explicit", "nude"],
    "violence": ["kill", "attack", "violent", "weapon"],
    "political extremism": ["extremist", "radical"],
    "discrimination": ["racial", "racist", "sexist"],
}
# Patterns. (?U) gives \b and \d their Unicode meaning on every JDK.
PII_LEGACY = r"(?U)\b(?:\d{3}-\d{2}-\d{4}|\(\d{3}\)\s*\d{3}-\d{4}|\d{10}|\d{9})\b"
# A phone number in brackets has no word character before it, so the legacy pattern misses it.
PII_STRICT = r"(?U)(?<!\w)(?:\d{3}-\d{2}-\d{4}|\(\d{3}\)\s*\d{3}-\d{4}|\d{10}|\d{9})\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PROFANE_WORDS = ["damn", "hell", "crap", "ass"]
# Answers that replace an unsafe response.
TEMPLATES = [
    "I cannot provide information about {topic}.",
    "I'm not able to assist with {topic}.",
    "That content violates usage policies.",
]
BLOCKED_TOPIC = "that request"
BLOCKED_VIOLATION = "Blocked due to unsafe input"
BLOCKED_ANSWER = "I'm sorry, I cannot respond to that query as it violates content policies."


@dataclass
class Policy:
    """What is screened. Lists are configuration, compiled into the expression."""

    level: str = "medium"
    topics_by_level: dict = field(default_factory=lambda: TOPICS_BY_LEVEL)
    keywords: dict = field(default_factory=lambda: TOPIC_KEYWORDS)
    pii: str = PII_LEGACY
    email: str = EMAIL
    profane: list = field(default_factory=lambda: PROFANE_WORDS)
    whole_word: bool = False
    templates: list = field(default_factory=lambda: TEMPLATES)
    # None picks a template by hash of the text; a number fixes it.
    template: int | None = None

    def topics(self, level: str | None = None) -> list[str]:
        """An unknown level screens no topics."""
        return self.topics_by_level.get(level or self.level, [])

    def profanity_active(self, level: str | None = None) -> bool:
        return (level or self.level) == "high"


def _text(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def profanity_pattern(policy: Policy) -> str:
    return r"(?iuU)\b(?:" + "|".join(policy.profane) + r")\b"


def topic_hit(text, topic: str, policy: Policy) -> Column:
    keywords = policy.keywords.get(topic, [])
    lowered = F.lower(_text(text))
    if not keywords:
        return F.lit(False)
    if policy.whole_word:
        return lowered.rlike(r"(?U)\b(?:" + "|".join(keywords) + r")\b")
    hit = lowered.contains(keywords[0])
    for k in keywords[1:]:
        hit = hit | lowered.contains(k)
    return hit


def topics_detected(text, policy: Policy, level: str | None = None) -> Column:
    topics = policy.topics(level)
    if not topics:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(topic_hit(text, t, policy), F.lit(t)) for t in topics]))


def has_pii(text, policy: Policy) -> Column:
    return _text(text).rlike(policy.pii)


def has_email(text, policy: Policy) -> Column:
    return _text(text).rlike(policy.email)


def has_profanity(text, policy: Policy, level: str | None = None) -> Column:
    if not policy.profanity_active(level):
        return F.lit(False)
    return _text(text).rlike(profanity_pattern(policy))


# Violation messages.
INPUT_MESSAGES = ("Banned topic: ", "PII detected: Possible SSN or phone number", "PII detected: Email address",
                  "Profanity detected")
OUTPUT_MESSAGES = ("Banned topic in response: ", "PII detected in response",
                   "Email address detected in response", "Profanity detected in response")


def _check(text, policy: Policy, level: str | None, messages, with_text: bool = False) -> Column:
    """Every test runs once per row: the flags are bound to a variable of a one-element transform, because
    the optimizer would otherwise repeat a test for each field that reads it."""
    topic_message, *flag_messages = messages
    text = _text(text)
    flags = F.struct(
        topics_detected(text, policy, level).alias("topics"),
        *[F.coalesce(c, F.lit(False)).alias(n) for n, c in (
            ("pii", has_pii(text, policy)), ("email", has_email(text, policy)),
            ("profanity", has_profanity(text, policy, level)))],
        *([text.alias("text")] if with_text else []),
    )

    def result(f: Column) -> Column:
        found = [f[n] for n in ("pii", "email", "profanity")]
        named = F.transform(f["topics"], lambda t: F.concat(F.lit(topic_message), t))
        others = F.array_compact(F.array(*[F.when(c, F.lit(m)) for c, m in zip(found, flag_messages)]))
        fields = [
            ((F.size(f["topics"]) == 0) & ~found[0] & ~found[1] & ~found[2]).alias("is_safe"),
            F.concat(named, others).alias("violations"),
            (found[0] | found[1]).alias("pii_detected"),
            f["topics"].alias("topics_detected"),
        ]
        if with_text:
            first = F.get(f["topics"], F.lit(0))
            fields.append(F.when(first.isNotNull(), template_answer(first, f["text"], policy)).otherwise(
                _redact(f["text"], policy, *found)).alias("safe_response"))
        return F.struct(*fields)

    return F.get(F.transform(F.array(flags), result), F.lit(0))


def _redact(text: Column, policy: Policy, pii, email, profanity) -> Column:
    """Replace what was found, in the order PII, email, profanity."""
    out = F.when(pii, F.regexp_replace(text, policy.pii, "[REDACTED PII]")).otherwise(text)
    out = F.when(email, F.regexp_replace(out, policy.email, "[REDACTED EMAIL]")).otherwise(out)
    return F.when(profanity, F.regexp_replace(out, profanity_pattern(policy), "[REDACTED]")).otherwise(out)


def check_input(text, policy: Policy = Policy(), level: str | None = None) -> Column:
    """struct(is_safe, violations, pii_detected, topics_detected); order topics, PII, email, profanity."""
    return _check(text, policy, level, INPUT_MESSAGES)


def redact(text, policy: Policy = Policy(), level: str | None = None) -> Column:
    out = F.regexp_replace(_text(text), policy.pii, "[REDACTED PII]")
    out = F.regexp_replace(out, policy.email, "[REDACTED EMAIL]")
    return F.regexp_replace(out, profanity_pattern(policy), "[REDACTED]") if policy.profanity_active(level) else out


def template_answer(topic: Column, key: Column, policy: Policy) -> Column:
    texts = [F.replace(F.lit(t), F.lit("{topic}"), topic) for t in policy.templates]
    if policy.template is not None:
        return texts[policy.template]
    return F.element_at(F.array(*texts), (F.pmod(F.xxhash64(key), F.lit(len(texts))) + 1).cast("int"))


def check_output(text, policy: Policy = Policy(), level: str | None = None) -> Column:
    """As check_input with response messages, plus safe_response: redacted, or a template on a topic hit."""
    return _check(text, policy, level, OUTPUT_MESSAGES, with_text=True)


def apply_guardrails(df: DataFrame, query: str, response: str, policy: Policy = Policy(),
                     level: str | None = None) -> DataFrame:
    """Adds input_check, output_check, safe_response and is_safe. The response of an unsafe question is
    replaced and not screened."""
    # the input check is its own projection, so it is evaluated once per row
    df = df.withColumn("input_check", check_input(query, policy, level))
    safe_in = F.col("input_check.is_safe")
    checked = F.when(safe_in, check_output(response, policy, level))
    df = df.withColumn("_out", checked)
    blocked = F.struct(F.lit(False).alias("is_safe"), F.array(F.lit(BLOCKED_VIOLATION)).alias("violations"))
    return df.withColumns({
        "output_check": F.when(safe_in, F.struct(F.col("_out.is_safe").alias("is_safe"),
                                                 F.col("_out.violations").alias("violations"))).otherwise(blocked),
        "safe_response": F.when(safe_in, F.col("_out.safe_response")).otherwise(
            template_answer(F.lit(BLOCKED_TOPIC), F.col(query), policy)),
        "is_safe": F.coalesce(safe_in & F.col("_out.is_safe"), F.lit(False)),
    }).drop("_out")


def split_blocked(df: DataFrame, query: str, policy: Policy = Policy(), level: str | None = None):
    """(questions to answer, blocked records). Only the first frame reaches the answer provider."""
    return split_checked(df.withColumn("guardrail_results", check_input(query, policy, level)))


def split_checked(checked: DataFrame):
    """As split_blocked, over rows that already hold their ``guardrail_results``."""
    blocked = checked.where(~F.col("guardrail_results.is_safe")).withColumns(
        {"status": F.lit("blocked"), "response": F.lit(BLOCKED_ANSWER)}
    )
    return checked.where(F.col("guardrail_results.is_safe")), blocked


def audit(df: DataFrame, day: str, violations: str) -> DataFrame:
    """Interventions per day and kind."""
    kinds = df.select(F.col(day).alias("date_day"), F.explode(violations).alias("violation"))
    return kinds.groupBy("date_day", "violation").agg(F.count(F.lit(1)).alias("interventions"))
