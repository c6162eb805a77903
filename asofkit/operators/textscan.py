"""Scan text columns for secrets and identifying details, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# The patterns, and which identifying categories block a release.
SECRET_PATTERNS = {
    "aws_access_key": r"AKIA[0-9A-Z]{16}",
    "private_key_header": r"-----BEGIN (RSA|DSA|EC|OPENSSH|PGP)? ?PRIVATE KEY-----",
    "bearer_token": r"[Bb]earer\s+[A-Za-z0-9._-]{20,}",
    "generic_assignment": r"(?i)\w*(?:api[_-]?key|password|secret|token)\w*\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+=.]{8,}['\"]?",
    "fred_api_key_env": r"\bFRED_API_KEY\b\s*[:=]\s*['\"a-zA-Z0-9]",
}
IDENTIFYING_PATTERNS = {
    "absolute_home_path": r"/(?:Users|home)/[A-Za-z0-9_.\-]+",
    "email_address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4_address": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "dev_session_url": r"\b[a-z0-9-]+(?:\.[a-z0-9-]+)+/code/session_[A-Za-z0-9]+",
    "home_dotdir_path": r"~/\.[A-Za-z0-9][A-Za-z0-9_-]*/",
}
BLOCKING = ("absolute_home_path", "email_address", "dev_session_url")
REVIEW = ("ipv4_address", "home_dotdir_path")

# Text every match must contain, in lower case: a cheap test before the pattern itself.
_NEEDS = {
    "aws_access_key": ["akia"], "private_key_header": ["private key"], "bearer_token": ["bearer"],
    "generic_assignment": ["key", "password", "secret", "token"], "fred_api_key_env": ["fred_api_key"],
    "absolute_home_path": ["/users/", "/home/"], "email_address": ["@"], "ipv4_address": ["."],
    "dev_session_url": ["/code/session_"], "home_dotdir_path": ["~/."],
}

_LINE_BREAK = "\r\n|[\n\r\u000B\f\u001C\u001D\u001E\u0085\u2028\u2029]"
_UNICODE = "(?U)"  # word characters and digits in every script


def scan_text(df: DataFrame, *, key: str, text: str) -> DataFrame:
    """(key, line_no, category, severity, fingerprint, redacted): the first match of each
    category on each line. Values are never shown; the fingerprint is 12 hex digits of sha256.

    Whole texts are scanned. Texts without any match are dropped before lines are exploded.
    """
    patterns = {f"secret:{k}": v for k, v in SECRET_PATTERNS.items()}
    patterns |= {f"identifying_info:{k}": v for k, v in IDENTIFYING_PATTERNS.items()}
    anywhere = F.lit(False)
    for c, p in patterns.items():
        cheap = F.lit(False)
        for word in _NEEDS[c.split(":")[1]]:
            cheap = cheap | F.contains(F.col("__lower"), F.lit(word))
        # a leading run of word characters does not decide whether there is a match
        anywhere = anywhere | (cheap & F.col(text).rlike(_UNICODE + p.replace(r"(?i)\w*", "(?i)")))
    lines = df.withColumn("__lower", F.lower(text)).where(anywhere).select(key, F.posexplode(F.split(text, _LINE_BREAK)).alias("__at", "__line"))
    # A leading run of word characters starts where a word starts: looking there only gives the same first match in linear time.
    hits = F.array(*[
        F.struct(F.lit(c).alias("category"), F.regexp_extract("__line", _UNICODE + p.replace(r"(?i)\w*", r"(?i)(?<!\w)\w*"), 0).alias("__match"))
        for c, p in patterns.items()])
    found = lines.select(key, (F.col("__at") + 1).alias("line_no"), F.inline(hits)).where(F.col("__match") != "")
    name = F.substring_index("category", ":", -1)
    severity = F.when(F.col("category").startswith("secret:") | name.isin(*BLOCKING), "hard_block").when(
        name.isin(*REVIEW), "review").otherwise("info")
    size = F.length("__match")
    hidden = F.when(size <= 4, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.left("__match", F.lit(2)), F.repeat(F.lit("*"), size - 4), F.right("__match", F.lit(2))))
    return found.select(
        key, "line_no", "category", severity.alias("severity"),
        F.concat(F.lit("fp:"), F.substring(F.sha2("__match", 256), 1, 12)).alias("fingerprint"), hidden.alias("redacted"))


def without_allowed(findings: DataFrame, allowed: DataFrame, *, key: str) -> DataFrame:
    """Findings that no allowlist row (key, fingerprint) covers."""
    return findings.join(allowed, [key, "fingerprint"], "left_anti")


def audit_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity", "category").agg(F.count("*").alias("n"))


def passes(findings: DataFrame) -> DataFrame:
    """One row: whether nothing blocks the release."""
    return findings.agg((F.count_if(F.col("severity") == "hard_block") == 0).alias("passed"), F.count("*").alias("n_findings"))
