"""A protocol for rules: plans over named facts that are staged once and shared, project accumulators, and measures of each rule.

A rule set names its rules and gives a plan from facts to rows (file, line, rule_id, and
any of symbol, value, detector, preview). Facts are made when a selected rule set first
asks for them and written once, so that rule sets that need the same lines,
declarations or segments read one table. A rule that no plan can express is a Python
function from a text to rows, run by a table function beside the units. A project rule
sees all files: what it accumulates is an aggregate over units, what it finishes a
plan over that aggregate.

With ``observe`` the rows that each rule set reads first and the findings that it gives
are counted while the findings are written or collected, without a job of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from plumbline.rules import code, conventions, flow, hierarchy, scopes, statements
from plumbline.sources.staging import staged

COLUMNS = {"file": "string", "line": "int", "rule_id": "string", "symbol": "string", "value": "bigint", "detector": "string", "preview": "string"}
PILLARS = {"docs": "documentation", "waste": "dead-code", "waste.one-line-method": "maintainability"}
# fixed values: severity, confidence -> rules, by the module that has them
CODE_RULES: dict[str, dict[tuple[str, str], tuple[str, ...]]] = {
    "code": {
        ("advisory", "high"): ("docs.missing-class-phpdoc", "naming.short-variable", "naming.test-naming-consistency", "test-quality.conditional-logic", "test-quality.test-method-too-long", "waste.empty-method"),
        ("advisory", "medium"): ("docs.missing-constant-phpdoc", "docs.missing-property-phpdoc", "naming.confusing-name", "naming.generic-method", "naming.hungarian-notation", "naming.identifier-quality", "waste.commented-out-code", "waste.empty-class"),
        ("error", "high"): ("complexity.nesting-depth", "docs.missing-public-phpdoc", "size.average-method-length", "size.class-length", "size.parameter-count", "size.property-count", "size.public-method-count"),
        ("error", "medium"): ("test-quality.no-assertions",),
        ("warning", "high"): ("complexity.cyclomatic", "dead-code.unused-private-constant", "dead-code.unused-private-method", "dead-code.unused-private-property", "modernisation.public-property", "naming.class-file-mismatch", "security.error-suppression", "security.insecure-random", "security.silent-catch", "security.weak-crypto", "test-quality.skipped-without-reason", "test-quality.sleep-in-test", "waste.unused-import"),
        ("warning", "medium"): ("modernisation.forbidden-global-access", "security.dangerous-function-call"),
    },
    "scopes": {
        ("advisory", "high"): ("docs.missing-param-tag", "docs.missing-return-tag", "docs.return-comment", "test-quality.data-provider-annotation"),
        ("advisory", "medium"): ("docs.bare-phpdoc-tags", "docs.missing-throws-tag", "naming.negative-boolean", "test-quality.exception-type-only", "test-quality.setup-bloat"),
        ("warning", "high"): ("docs.stale-param-tag", "security.disabled-ssl-verification", "test-quality.private-reflection", "test-quality.trivial-assertion", "waste.unused-parameter"),
        ("warning", "medium"): ("security.debug-mode-enabled", "security.unsafe-unserialize"),
    },
    "statements": {
        ("advisory", "high"): ("waste.redundant-variable",),
        ("advisory", "low"): ("test-quality.repeated-structure-missing-data-provider",),
        ("advisory", "medium"): ("complexity.halstead-volume", "complexity.maintainability-index", "modernisation.match-expression-candidate"),
        ("error", "high"): ("complexity.cognitive", "size.method-length"),
        ("warning", "high"): ("waste.unreachable-code",),
    },
    "hierarchy": {
        ("advisory", "medium"): ("waste.one-line-method",),
    },
    "conventions": {
        ("advisory", "high"): ("naming.abbreviation-allowlist",),
        ("advisory", "medium"): ("docs.missing-file-phpdoc", "modernisation.mixed-type-overuse"),
        ("warning", "high"): ("docs.var-annotation-description",),
        ("warning", "medium"): ("security.permissive-cors",),
    },
    "flow": {
        ("warning", "medium"): ("security.extract-compact-user-input", "security.header-injection", "security.path-traversal-file-access", "security.process-command-construction", "security.reflected-xss", "security.request-controlled-url", "security.sensitive-data-logging", "security.sql-concatenation", "security.unsafe-archive-extraction", "security.unsafe-xml-loading", "security.variable-include"),
    },
}


def definitions(rules: dict[tuple[str, str], tuple[str, ...]]) -> dict[str, tuple[str, str, str]]:
    """rule -> pillar, severity, confidence."""
    return {r: (PILLARS.get(r) or PILLARS.get(r.split(".")[0], r.split(".")[0]), s, c) for (s, c), names in rules.items() for r in names}


class Facts:
    """Named tables over units (file, type, source), each made once."""

    def __init__(self, units: DataFrame):
        self._held = {"units": units, "code": units.where("type = 'php'").select("file", "source")}
        self._makers: dict[str, Callable[[Facts], DataFrame]] = {
            "lines": lambda f: scopes.comment_blocks(code.code_lines(f["code"])),
            "declarations": lambda f: code.measured(f["lines"], code.declarations(f["lines"])),
            "segments": lambda f: statements.staged_segments(f["code"], "facts-segments"),
            "metrics": lambda f: statements.function_metrics(f["segments"]),
        }

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._held:
            made = self._makers[name](self)
            self._held[name] = made if name == "segments" else staged(made, f"facts-{name}")  # segments are written in buckets
        return self._held[name]

    @property
    def made(self) -> set[str]:
        return set(self._held)

    def add(self, name: str, make: Callable[[Facts], DataFrame]) -> None:
        """Another fact, made from these."""
        if name in self._held or name in self._makers:
            raise ValueError(f"there is a fact {name} already")
        self._makers[name] = make


@dataclass(frozen=True)
class RuleSet:
    """Rules (rule -> pillar, severity, confidence) and the plan that gives their findings; ``reads`` is the fact whose rows count as read."""

    name: str
    rules: dict[str, tuple[str, str, str]]
    plan: Callable[[Facts], DataFrame]
    reads: str = "units"


def row_rule(name: str, rules: dict[str, tuple[str, str, str]], function: Callable[[str, str], Iterable[tuple]], where: str = "true") -> RuleSet:
    """A rule as a Python function (file, text) -> rows (line, rule_id, symbol, value), on the units that meet a condition."""
    class Found:
        def eval(self, file: str, source: str):
            yield from function(file, source)

    def plan(facts: Facts) -> DataFrame:
        found = F.udtf(Found, returnType="line int, rule_id string, symbol string, value bigint")
        units = facts["units"].where(where)
        return units.lateralJoin(found(F.col("file").outer(), F.col("source").outer())).select("file", "line", "rule_id", "symbol", "value")

    return RuleSet(name, rules, plan)


def project_rule(name: str, rules: dict[str, tuple[str, str, str]], fact: str, keys: tuple[str, ...], accumulate: dict[str, Column], finish: Callable[[DataFrame], DataFrame]) -> RuleSet:
    """A rule over all files: ``accumulate`` are aggregates by ``keys`` (none: one row) over a fact, ``finish`` makes findings of them."""
    def plan(facts: Facts) -> DataFrame:
        return finish(facts[fact].groupBy(*keys).agg(*[c.alias(n) for n, c in accumulate.items()]))

    return RuleSet(name, rules, plan, fact)


def built_in(limits: dict[str, float] | None = None) -> tuple[RuleSet, ...]:
    """The rules over code, with thresholds other than the usual."""
    rules = {name: definitions(groups) for name, groups in CODE_RULES.items()}
    return (
        RuleSet("code", rules["code"], lambda f: code.code_findings(f["code"], f["lines"], f["declarations"], limits), "lines"),
        RuleSet("scopes", rules["scopes"], lambda f: scopes.scope_findings(f["code"], f["lines"], f["declarations"]), "lines"),
        RuleSet("statements", rules["statements"], lambda f: statements.statement_findings(f["code"], rows=f["segments"], metrics=f["metrics"], limits=limits), "segments"),
        RuleSet("hierarchy", rules["hierarchy"], lambda f: hierarchy.one_line_methods(f["segments"]), "segments"),
        RuleSet("conventions", rules["conventions"], lambda f: conventions.convention_findings(f["lines"], f["declarations"], f["segments"]), "segments"),
        RuleSet("flow", rules["flow"], lambda f: flow.flow_findings(f["code"], f["segments"]), "segments"),
    )


def evaluate(facts: Facts, rule_sets: Iterable[RuleSet], names: set[str], observe: bool = False) -> tuple[list[DataFrame], dict[str, tuple[Observation, Observation]]]:
    """Findings of each rule set that has a rule among ``names``, and what was observed: (rows read, findings)."""
    found, seen = [], {}
    for rules in rule_sets:
        wanted = names & rules.rules.keys()
        if not wanted:
            continue
        if observe:
            read, given = Observation(f"{rules.name} read"), Observation(f"{rules.name} found")
            whole, facts_now = facts[rules.reads], Facts.__new__(Facts)
            facts_now._held, facts_now._makers = facts._held | {rules.reads: whole.observe(read, F.count(F.lit(1)).alias("rows"))}, facts._makers
            rows = rules.plan(facts_now)
            facts._held |= {k: v for k, v in facts_now._held.items() if k not in facts._held}
        else:
            rows = rules.plan(facts)
        rows = rows.where(F.col("rule_id").isin(*sorted(wanted)))
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])
        if observe:
            rows = rows.observe(given, F.count(F.lit(1)).alias("rows"))
            seen[rules.name] = (read, given)
        found.append(rows)
    return found, seen
