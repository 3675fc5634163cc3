"""Why a value that looks random is no secret.

Tests are columns over a value and, where it matters, the line that it stands on or
the key that it is given to. ``of_literal`` and ``of_assignment`` name the first that
holds, or are null; so a report can say why nothing was found. A null value has no
exemption; an empty one has none either.

A compound of words is told from a key with a prefix by its characters: letters in
words of three or more must be the greater part of all letters and digits, and no
part of 16 or more characters may be made of something else for half or more.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.text import HUMPS

# fixed values: shapes and limits that decide what is exempt; results equal others' only with these as they stand
OWNED = ("AKIA", "ASIA", "sk_live_", "sk-proj-", "sk-ant-", "ghp_", "gho_", "ghr_", "ghs_", "ghu_", "github_pat_", "glpat-", "npm_", "AIza", "xox", "https://hooks.slack.com/services/")
KEYSPACES = ("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", "abcdefghijklmnopqrstuvwxyz0123456789-_")
FILE_NAME = r"(?i)/.*\.(?:php|inc|json|xml|neon|ya?ml|txt|md|stub|sh)$"
ROUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*|\.{0,2})(/[A-Za-z0-9._~/%:-]+)$"
SETTING = r"^(?:rules|paths|allowlists|selection)\.[A-Za-z0-9_.-]+$"
COMPOUND = r"^[A-Za-z0-9]+(?:[/._-]+[A-Za-z0-9]+)+$|^[A-Za-z][A-Za-z0-9_]*(?:\.[A-Za-z][A-Za-z0-9_]*){2,}$"
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*$"
PROVIDER = r"\bDataProvider\s*\("
CLINICAL_LINE = r"(?i)CodeSystem|ConceptCode|HL7|OID|ValueSet"
CLINICAL_FIELD = r"(?i)CodeSystemCode|HL7Table|ValueSetCode"
CLINICAL_CODE = r"^(?:PH|PHVS)_[A-Za-z0-9_]+_HL7_V\d+$|^\d+(?:\.\d+){3,}$"
LABEL = r"^[a-z][a-z0-9-]{1,24}$|^[a-z][a-z0-9_]{1,40}$|^[a-z][a-z0-9_.-]+[._-]$"
MATERIAL = r"\d|[+/=]"
LOOKUP_NAME = r"^[A-Za-z][A-Za-z0-9_.:-]{1,80}$"
FIELD_NAME = r"^[a-z][A-Za-z]{7,40}$"
WORD, LONG_PART, LETTERS = 3, 16, 48


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out |= test
    return out


def owned(value: Column, token: str) -> Column:
    """Another rule's: a known prefix, a whole token of the given format, or up to 48 letters and nothing else."""
    return _any([value.startswith(p) for p in OWNED]) | value.rlike(f"^(?:{token})$") | ((F.length(value) <= LETTERS) & value.rlike("^[A-Za-z]+$"))


def route(value: Column) -> Column:
    """A path of an address, or one from a root, with a word in it."""
    hook = value.startswith(OWNED[-1])
    return ~hook & F.regexp_extract(value, ROUTE, 1).rlike("[A-Za-z]{3}")


def compound(value: Column) -> Column:
    """An identifier or slug of two parts or more that is mostly words."""
    def letters(part: Column) -> Column:
        words = F.filter(F.regexp_extract_all(part, F.lit(HUMPS), F.lit(0)), lambda w: w.rlike(f"^[A-Za-z]{{{WORD},}}$"))
        return F.when(part.rlike("^[A-Za-z]*$"), F.when(F.length(part) >= WORD, F.length(part)).otherwise(0)).otherwise(F.length(F.array_join(words, "")))

    weighed = F.transform(F.split(value, "[/._-]+"), lambda p: F.struct(F.length(p).alias("all"), letters(p).alias("words")))
    start = F.struct(F.lit(False).alias("random_part"), F.lit(0).alias("excess"))
    add = lambda s, p: F.struct((s["random_part"] | ((p["all"] >= LONG_PART) & (2 * p["words"] <= p["all"]))).alias("random_part"), (s["excess"] + 2 * p["words"] - p["all"]).alias("excess"))
    return F.when(value.rlike(COMPOUND), F.aggregate(weighed, start, add, lambda s: ~s["random_part"] & (s["excess"] > 0))).otherwise(False)


def clinical(value: Column, line: Column) -> Column:
    """A code of a public terminology, on a line that names one."""
    return line.rlike(CLINICAL_LINE) & (value.rlike(CLINICAL_CODE) | (value.contains("HL7") & line.rlike(CLINICAL_FIELD)))


def of_literal(value: Column, line: Column, token: str) -> Column:
    """The exemption of a quoted literal on its line: other-rule, path, setting, words, keyspace, provider or clinical-code."""
    tests = {
        "other-rule": owned(value, token), "path": route(value) | value.rlike(FILE_NAME), "setting": value.rlike(SETTING), "words": compound(value),
        "keyspace": value.isin(*KEYSPACES), "provider": value.rlike(IDENTIFIER) & line.rlike(PROVIDER), "clinical-code": clinical(value, line),
    }
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests.items()])


def of_assignment(key: Column, value: Column) -> Column:
    """The exemption of a value given to a secret-like key: label, period, lookup-name or field-name."""
    upper, plain = F.upper(key), ~value.rlike(MATERIAL)
    tests = {
        "label": value.rlike(LABEL), "period": plain & (upper.endswith("_EXPIRES_AT") | upper.endswith("_VALID_PERIOD")),
        "lookup-name": plain & upper.endswith("_KEY") & value.rlike(LOOKUP_NAME), "field-name": plain & value.rlike(FIELD_NAME),
    }
    return F.coalesce(*[F.when(test, F.lit(name)) for name, test in tests.items()])
