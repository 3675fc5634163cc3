"""The rules that run on any text, their settings and selection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans import protocol
from plumbline.rules import text

RULE_SCHEMA = "rule_id string, pillar string, tier string, severity string, confidence string, enabled boolean"
# fixed values: rule, pillar, severity, confidence
RULES = (
    ("sensitive-data.api-key-pattern", "sensitive-data", "warning", "high"),
    ("sensitive-data.aws-access-key", "sensitive-data", "warning", "high"),
    ("sensitive-data.database-url-password", "sensitive-data", "warning", "high"),
    ("sensitive-data.gcp-service-account-key", "sensitive-data", "warning", "high"),
    ("sensitive-data.hardcoded-env-value", "sensitive-data", "warning", "medium"),
    ("sensitive-data.high-entropy-string", "sensitive-data", "warning", "medium"),
    ("sensitive-data.jwt-token", "sensitive-data", "warning", "medium"),
    ("sensitive-data.phi-pattern", "sensitive-data", "warning", "medium"),
    ("sensitive-data.pii-test-fixture", "sensitive-data", "warning", "medium"),
    ("sensitive-data.private-key", "sensitive-data", "warning", "high"),
    ("sensitive-data.url-credentials", "sensitive-data", "warning", "high"),
    ("size.file-length", "size", "error", "high"),
    ("docs.todo-density", "documentation", "error", "high"),
)


TIER = "v0.1"


@dataclass(frozen=True)
class Selection:
    """Which rules run: any include that names a rule, less every exclude."""

    tiers: tuple[str, ...] = ()
    pillars: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    without_pillars: tuple[str, ...] = ()
    without_rules: tuple[str, ...] = ()
    disabled: frozenset[str] = field(default_factory=frozenset)

    def names(self, known: dict[str, tuple[str, str, str]] | None = None) -> dict[str, tuple[str, str, str]]:
        """Pillar, severity and confidence of the selected ones of known rules, while the plan is made."""
        free = not (self.tiers or self.pillars or self.rules)
        known = known or {r: (p, s, c) for r, p, s, c in RULES}
        chosen = [(r, *v) for r, v in known.items() if free or TIER in self.tiers or v[0] in self.pillars or r in self.rules]
        return {r: (p, s, c) for r, p, s, c in chosen if p not in self.without_pillars and r not in self.without_rules and r not in self.disabled}

    def apply(self, rules: DataFrame) -> DataFrame:
        included = F.lit(not (self.tiers or self.pillars or self.rules))
        for column, names in (("tier", self.tiers), ("pillar", self.pillars), ("rule_id", self.rules)):
            if names:
                included |= F.col(column).isin(*names)
        out = rules.where(included & F.col("enabled"))
        for column, names in (("pillar", self.without_pillars), ("rule_id", self.without_rules), ("rule_id", tuple(self.disabled))):
            if names:
                out = out.where(~F.col(column).isin(*names))
        return out


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, p, TIER, s, c, True) for r, p, s, c in RULES], RULE_SCHEMA)


def suggestions(rules: DataFrame, name: str, most: int = 3) -> DataFrame:
    """The rules with names nearest to a mistyped one."""
    return rules.select("rule_id", F.levenshtein("rule_id", F.lit(name)).alias("distance")).orderBy("distance", "rule_id").limit(most)


def all_rules(more: tuple[protocol.RuleSet, ...] = ()) -> dict[str, tuple[str, str, str]]:
    """Pillar, severity and confidence of every rule that analyse can run."""
    found = {r: (p, s, c) for r, p, s, c in RULES}
    for rules in (*protocol.built_in(), *more):
        found |= rules.rules
    return found


def _evaluated(units: DataFrame, selection: Selection | None, max_lines: int, more: tuple[protocol.RuleSet, ...], observe: bool, limits: dict[str, float] | None = None, severities: dict[str, str] | None = None):
    known = all_rules(more)
    names = {r: (p, (severities or {}).get(r, s), c) for r, (p, s, c) in (selection or Selection()).names(known).items()}
    texts = {r for r, *_ in RULES} & names.keys()
    whole = {"size.file-length", "docs.todo-density"}
    sets = [
        protocol.RuleSet("lines of texts", {r: known[r] for r in set(text.RULE_OF.values())}, lambda f: text.scan(f["units"], texts)),
        protocol.RuleSet("service accounts", {"sensitive-data.gcp-service-account-key": known["sensitive-data.gcp-service-account-key"]}, lambda f: text.service_account_keys(f["units"])),
        protocol.RuleSet("whole texts", {r: known[r] for r in whole}, lambda f: text.whole_texts(f["units"], texts, max_lines)),
        *protocol.built_in(limits), *more,
    ]
    facts = protocol.Facts(units)
    over_code = {r for rules in protocol.built_in() for r in rules.rules} & names.keys()
    if over_code and facts["code"].isEmpty():  # then none of the facts of code is made
        sets = [x for x in sets if not over_code & x.rules.keys()]
    found, seen = protocol.evaluate(facts, sets, set(names), observe)
    if not found:
        found = [units.limit(0).select("file", *[F.lit(None).cast(t).alias(c) for c, t in protocol.COLUMNS.items() if c != "file"])]
    rows = found[0]
    for part in found[1:]:
        rows = rows.unionByName(part)
    if not names:
        return rows.withColumns({c: F.lit(None).cast("string") for c in ("pillar", "severity", "confidence")}), seen
    entries = F.create_map(*[F.lit(x) for r, v in names.items() for x in (r, "|".join(v))])
    parts = F.split(F.element_at(entries, F.col("rule_id")), r"\|")
    return rows.withColumns({"pillar": parts[0], "severity": parts[1], "confidence": parts[2]}), seen


def analyse(units: DataFrame, selection: Selection | None = None, max_lines: int = 1000, more: tuple[protocol.RuleSet, ...] = (), limits: dict[str, float] | None = None, severities: dict[str, str] | None = None) -> DataFrame:
    """Findings of the selected rules on units (file, type, source).

    Columns: file, line, rule_id, symbol, value, detector, preview, pillar, severity,
    confidence. Only what selected rules need is in the plan; code rules read units of
    type php. ``more`` are rule sets of one's own, which share the facts of the others.
    ``limits`` and ``severities`` are those of rules that settings change.
    """
    return _evaluated(units, selection, max_lines, more, False, limits, severities)[0]


def analyse_observed(units: DataFrame, selection: Selection | None = None, max_lines: int = 1000, more: tuple[protocol.RuleSet, ...] = ()) -> tuple[DataFrame, dict]:
    """What analyse gives, and per rule set the observations (rows read, findings), which have values after an action on the findings."""
    return _evaluated(units, selection, max_lines, more, True)
