"""Units, findings, changed ranges, mutants and history derived from the star-schema tables.

The tables hold no source code, so findings are derived from events, changed
ranges from line items, mutants from orders and score history from days of
events, each by arithmetic that SQL can repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: event type -> rule, pillar, severity, confidence
RULE_OF_EVENT = {
    "purchase": ("complexity.cyclomatic", "complexity", "warning", "high"),
    "view": ("complexity.cognitive", "complexity", "error", "high"),
    "signup": ("size.method-length", "size", "error", "high"),
    "error": ("security.weak-hash", "security", "warning", "medium"),
    "click": ("naming.identifier-quality", "naming", "advisory", "medium"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as text units under tests/."""
    d = table(spark, sf_dir, "documents")
    file = F.concat_ws("/", F.lit("tests"), F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select(file.alias("file"), F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("source"))


def page_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return p.select(F.concat(F.lit("pages/p"), F.col("page_id").cast("string"), F.lit(".xml")).alias("file"), F.lit("text").alias("type"), F.coalesce("html", F.lit("")).alias("source"))


def conversation_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat(F.lit("docs/c"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"), F.lit(".md")).alias("file"), F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("source"))


def service_account_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON file per customer: service accounts with keys of several lengths, without one, and other kinds."""
    k = F.col("c_custkey")
    key = F.repeat(F.md5(k.cast("string").cast("binary")), (k % 6).cast("int"))
    field = F.when(k % 5 == 0, '  "client_id": "7"').otherwise(F.concat(F.lit('  "private_key": "-----BEGIN PRIVATE KEY-----\\n'), key, F.lit('\\n-----END PRIVATE KEY-----\\n"')))
    source = F.concat(F.lit('{\n  "type": "'), F.when(k % 7 == 0, "user").otherwise("service_account"), F.lit('",\n'), field, F.lit("\n}"))
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("keys/c"), k.cast("string"), F.lit(".json")).alias("file"), F.lit("text").alias("type"), source.alias("source"))


def workflow_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow file per supplier: its trigger, permissions, action and run block vary by key."""
    k = F.col("s_suppkey")
    source = F.concat_ws("\n",
        F.when(k % 2 == 0, "on: pull_request_target").otherwise("on: push"), F.when(k % 3 == 0, "permissions: write-all").otherwise("permissions: read-all"), F.lit("jobs:\n  a:\n    steps:"),
        F.concat(F.lit("      - uses: x/y@"), F.element_at(F.array(*map(F.lit, ("main", "v1", "latest", "0123abc"))), (k % 4 + 1).cast("int"))),
        F.when(k % 5 == 0, "      - name: n").otherwise("      - run: |"), F.lit("          echo ${{ github.event.title }}"), F.lit("      - name: m\n        with:\n          t: ${{ github.event.title }}"),
    )
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), k.cast("string"), F.lit("/.github/workflows/ci.yml")).alias("file"), F.lit("text").alias("type"), source.alias("source"))


def _rule(i: int) -> Column:
    out = F.lit(None).cast("string")
    for event, values in RULE_OF_EVENT.items():
        out = F.when(F.col("event_type") == event, values[i]).otherwise(out)
    return out


def findings(spark: SparkSession, sf_dir: str, where: str = "true") -> DataFrame:
    """One finding per event that meets a condition."""
    e = table(spark, sf_dir, "events").where(where)
    e = e.select(
        F.col("event_id").alias("ord"), _rule(0).alias("rule_id"), F.concat(F.lit("src/m"), (F.col("user_id") % 97).cast("string"), F.lit(".php")).alias("file"),
        (F.col("event_id") % 40 + 1).cast("int").alias("line"), (F.col("event_id") % 40 + 1 + F.col("event_id") % 3).cast("int").alias("end_line"), F.lit(None).cast("int").alias("column"),
        F.concat(F.lit("S"), (F.col("user_id") % 13).cast("string")).alias("symbol"), _rule(2).alias("severity"), _rule(1).alias("pillar"), _rule(3).alias("confidence"),
        (F.abs("value").cast("int") % 30).alias("m_complexity"), (F.col("event_id") % 200).cast("int").alias("m_lines"), F.lit(None).cast("string").alias("preview"),
    )
    return e.where("rule_id is not null").withColumn("message", F.concat("rule_id", F.lit(" in "), "symbol"))


CURRENT, BASE, ACCEPTED = "event_id % 5 <> 0", "event_id % 3 <> 0", "event_id % 2 = 0"


def findings_sql(where: str = "true") -> str:
    """The same findings in DuckDB SQL."""
    pick = lambda i: "CASE event_type " + " ".join(f"WHEN '{e}' THEN '{v[i]}'" for e, v in RULE_OF_EVENT.items()) + " END"
    return f"""(SELECT *, rule_id || ' in ' || symbol AS message FROM (
      SELECT event_id AS ord, {pick(0)} AS rule_id, 'src/m' || (user_id % 97) || '.php' AS file, (event_id % 40 + 1)::INT AS line, (event_id % 40 + 1 + event_id % 3)::INT AS end_line,
             'S' || (user_id % 13) AS symbol, {pick(2)} AS severity, {pick(1)} AS pillar, {pick(3)} AS confidence, (trunc(abs(value))::INT % 30)::INT AS m_complexity, (event_id % 200)::INT AS m_lines
      FROM events WHERE {where}) WHERE rule_id IS NOT NULL)"""


def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed line ranges of files: file, start, end. One file in ten of those named has changed without ranges."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("src/m"), (F.col("l_orderkey") % 20011).cast("string"), F.lit(".php")).alias("file"), (F.col("l_partkey") % 30 + 1).cast("int").alias("start"), (F.col("l_partkey") % 30 + 1 + F.col("l_suppkey") % 5).cast("int").alias("end")).distinct()


RANGES_SQL = "(SELECT DISTINCT 'src/m' || (l_orderkey % 20011) || '.php' AS file, (l_partkey % 30 + 1)::INT AS start, (l_partkey % 30 + 1 + l_suppkey % 5)::INT AS \"end\" FROM lineitem)"


def declarations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested declaration ranges of files: file, start, end."""
    p = table(spark, sf_dir, "part")
    file = F.concat(F.lit("src/m"), (F.col("p_partkey") % 97).cast("string"), F.lit(".php"))
    return p.select(file.alias("file"), (F.col("p_partkey") % 35 + 1).cast("int").alias("start"), (F.col("p_partkey") % 35 + 1 + F.col("p_size") % 20).cast("int").alias("end")).distinct()


DECLARATIONS_SQL = "(SELECT DISTINCT 'src/m' || (p_partkey % 97) || '.php' AS file, (p_partkey % 35 + 1)::INT AS start, (p_partkey % 35 + 1 + p_size % 20)::INT AS \"end\" FROM part)"

# fixed values: order priority -> mutant status
STATUS_OF_PRIORITY = {"1": "escaped", "2": "killed", "3": "killed by SA", "4": "timed out", "5": "not covered"}


def mutants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutants: file, line, mutator, status."""
    o = table(spark, sf_dir, "orders")
    status = F.lit("error")
    for digit, name in STATUS_OF_PRIORITY.items():
        status = F.when(F.substring("o_orderpriority", 1, 1) == digit, name).otherwise(status)
    return o.select(F.col("o_orderkey").alias("ord"), F.concat(F.lit("src/m"), (F.col("o_custkey") % 50).cast("string"), F.lit(".php")).alias("file"), (F.col("o_orderkey") % 90 + 1).cast("int").alias("line"), F.concat(F.lit("Mutator"), (F.col("o_orderkey") % 6).cast("string")).alias("mutator"), status.alias("status"))


MUTANTS_SQL = (
    "(SELECT o_orderkey AS ord, 'src/m' || (o_custkey % 50) || '.php' AS file, (o_orderkey % 90 + 1)::INT AS line, 'Mutator' || (o_orderkey % 6) AS mutator, CASE o_orderpriority[1] "
    + " ".join(f"WHEN '{d}' THEN '{s}'" for d, s in STATUS_OF_PRIORITY.items())
    + " ELSE 'error' END AS status FROM orders)"
)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score history: ord, scope, score, findings; one entry per day and event type, errors without a scope."""
    e = table(spark, sf_dir, "events")
    day = F.date_trunc("day", "ts")
    out = e.groupBy(F.unix_timestamp(day).alias("ord"), "event_type").agg(F.count("*").alias("findings"), (F.sum(F.col("event_id") % 1000) % 10000 / 100).alias("score"))
    return out.select("ord", F.when(F.col("event_type") != "error", F.col("event_type")).alias("scope"), F.round("score", 2).alias("score"), "findings")


HISTORY_SQL = "(SELECT epoch(date_trunc('day', ts))::BIGINT AS ord, CASE WHEN event_type <> 'error' THEN event_type END AS scope, round((sum(event_id % 1000) % 10000)::DOUBLE / 100, 2) AS score, count(*) AS findings FROM events GROUP BY ts::DATE, date_trunc('day', ts), event_type)"


def config_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One settings file per customer, with keys and addresses made from digests."""
    c = table(spark, sf_dir, "customer")
    d = F.md5(F.col("c_custkey").cast("string").cast("binary"))
    part = lambda a, n: F.substring(d, a, n)
    rows = F.array_compact(F.array(
        F.concat(F.lit("aws AKIA"), F.upper(part(1, 16))),
        F.concat(F.lit("stripe sk_live_"), part(1, 24), F.lit(" npm npm_"), part(3, 22)),
        F.concat(F.lit("jwt eyJ"), part(1, 12), F.lit(".eyJ"), part(5, 12), F.lit("."), part(9, 12)),
        F.when(F.col("c_custkey") % 3 == 0, F.lit("-----BEGIN RSA PRIVATE KEY-----")),
        F.concat(F.lit("db postgres://u:"), part(1, 9), F.lit("@db/x web https://u:"), part(11, 7), F.lit("@host/y")),
        F.concat(F.lit("patient ssn 123-45-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0")),
    ))
    return c.select(F.concat(F.lit("conf/c"), F.col("c_custkey").cast("string"), F.lit(".ini")).alias("file"), F.lit("text").alias("type"), F.array_join(rows, "\n").alias("source"))


CONFIGS_SQL = """(SELECT 'conf/c' || c_custkey || '.ini' AS file, 'aws AKIA' || upper(substr(d, 1, 16)) || chr(10) || 'stripe sk_live_' || substr(d, 1, 24) || ' npm npm_' || substr(d, 3, 22) || chr(10)
  || 'jwt eyJ' || substr(d, 1, 12) || '.eyJ' || substr(d, 5, 12) || '.' || substr(d, 9, 12) || chr(10) || CASE WHEN c_custkey % 3 = 0 THEN '-----BEGIN RSA PRIVATE KEY-----' || chr(10) ELSE '' END
  || 'db postgres://u:' || substr(d, 1, 9) || '@db/x web https://u:' || substr(d, 11, 7) || '@host/y' || chr(10) || 'patient ssn 123-45-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS source
  FROM (SELECT c_custkey, md5(c_custkey::VARCHAR) AS d FROM customer))"""


def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small class file per part."""
    k = F.col("p_partkey")
    text = k.cast("string")
    lines = F.array(
        F.lit("<?php"),
        F.concat(F.lit("use A\\B"), text, F.lit(";")),
        F.when(k % 3 == 0, "").otherwise("/** Doc. */"),
        F.concat(F.lit("class "), F.when(k % 5 == 0, "D").otherwise("C"), text),
        F.when(k % 2 == 0, F.concat(F.lit("{ // B"), text)).otherwise("{"),
        F.lit("    private const X = 1;"),
        F.lit("    /** p { */"),
        F.lit("    public $p = '}';"),
        F.lit("    /** d */"),
        F.concat(F.lit("    public function run($a1) { return "), F.when(k % 4 == 0, "self::X").otherwise("$a1"), F.lit("; }")),
        F.lit("    private function f($v) { return md5($v); }"),
        F.lit("}"),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("src/C"), text, F.lit(".php")).alias("file"), F.lit("php").alias("type"), F.array_join(lines, "\n").alias("source"))


def _expected(rule: str, line: int, symbol: str = "NULL", where: str = "true") -> str:
    return f"SELECT 'src/C' || p_partkey || '.php' AS file, {line}::INT AS line, '{rule}' AS rule_id, {symbol} AS symbol, NULL::BIGINT AS value FROM part WHERE {where}"


NAME = "CASE WHEN p_partkey % 5 = 0 THEN 'D' ELSE 'C' END || p_partkey"
CODE_FINDINGS_SQL = " UNION ALL ".join([
    _expected("waste.unused-import", 2, "'B' || p_partkey", "p_partkey % 2 = 1"),
    _expected("docs.missing-class-phpdoc", 4, NAME, "p_partkey % 3 = 0"),
    _expected("naming.class-file-mismatch", 4, NAME, "p_partkey % 5 = 0"),
    _expected("docs.missing-constant-phpdoc", 6, "'X'"),
    _expected("dead-code.unused-private-constant", 6, "'X'", "p_partkey % 4 <> 0"),
    _expected("modernisation.public-property", 8, "'p'"),
    _expected("naming.short-variable", 8, "'p'"),
    _expected("naming.generic-method", 10, "'run'"),
    _expected("docs.missing-public-phpdoc", 11, "'f'"),
    _expected("dead-code.unused-private-method", 11, "'f'"),
    _expected("naming.short-variable", 11, "'v'"),
    _expected("security.weak-crypto", 11),
])
CODE_SCOPES_SQL = f"""SELECT 'src/C' || p_partkey || '.php' AS file, kind, CASE WHEN kind = 'class' THEN {NAME} ELSE name END AS name, s AS start, e AS "end", visibility
  FROM part, (VALUES ('class', 'c', 4, 12, 'public'), ('method', 'run', 10, 10, 'public'), ('method', 'f', 11, 11, 'private')) v(kind, name, s, e, visibility)"""


def scope_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One test class per part, with comment blocks, parameters and bodies that vary by key."""
    k = F.col("p_partkey")
    lines = F.array(
        F.lit("<?php"),
        F.concat(F.lit("class T"), k.cast("string"), F.lit("Test {")),
        F.lit("    /**"),
        F.concat(F.lit("     * @param int $"), F.when(k % 11 == 0, "b").otherwise("a"), F.when(k % 3 == 0, " The first.").otherwise("")),
        F.when(k % 4 == 0, "     * Text only.").otherwise("     * @return int"),
        F.lit("     */"),
        F.lit("    public function run(int $a, bool $noCache) {"),
        F.when(k % 5 == 0, "        ini_set('display_errors', '1');").otherwise("        $x = unserialize($a);"),
        F.when(k % 7 == 0, "        throw new X();").otherwise("        return $a;"),
        F.lit("    }"),
        F.lit("    /** @dataProvider rows */"),
        F.lit("    public function testIt() {"),
        F.when(k % 2 == 0, "        $this->expectException(X::class);").otherwise("        $this->assertSame(1, 1);"),
        F.when(k % 3 == 0, "        $this->expectExceptionMessage('m');").otherwise("        new \\ReflectionMethod($this, 'b');"),
        F.lit("    }"),
        F.lit("    protected function setUp(): void {"),
        F.array_join(F.array_repeat(F.lit("        $this->a = 1;"), F.when(k % 13 == 0, 9).otherwise(1)), "\n"),
        F.lit("    }"),
        F.lit("}"),
    )
    return table(spark, sf_dir, "part").select(F.concat(F.lit("tests/T"), k.cast("string"), F.lit("Test.php")).alias("file"), F.lit("php").alias("type"), F.array_join(lines, "\n").alias("source"))


def _scoped(rule: str, line: int, symbol: str | None = None, where: str = "true", value: str = "NULL") -> str:
    name = "NULL" if symbol is None else f"'{symbol}'"
    return f"SELECT 'tests/T' || p_partkey || 'Test.php' AS file, {line}::INT AS line, '{rule}' AS rule_id, {name} AS symbol, {value}::BIGINT AS value FROM part WHERE {where}"


SCOPE_FINDINGS_SQL = " UNION ALL ".join([
    _scoped("security.debug-mode-enabled", 8, None, "p_partkey % 5 = 0"),
    _scoped("security.unsafe-unserialize", 8, None, "p_partkey % 5 <> 0"),
    _scoped("docs.bare-phpdoc-tags", 7, "run", "p_partkey % 3 <> 0 AND p_partkey % 4 <> 0"),
    _scoped("docs.missing-return-tag", 7, "run", "p_partkey % 4 = 0"),
    _scoped("docs.missing-return-tag", 12, "testIt"),
    _scoped("docs.missing-throws-tag", 7, "run", "p_partkey % 7 = 0"),
    _scoped("docs.return-comment", 7, "run", "p_partkey % 4 <> 0 AND p_partkey % 7 <> 0"),
    _scoped("test-quality.data-provider-annotation", 12, "testIt"),
    _scoped("docs.missing-param-tag", 7, "noCache"),
    _scoped("docs.missing-param-tag", 7, "a", "p_partkey % 11 = 0"),
    _scoped("docs.stale-param-tag", 7, "b", "p_partkey % 11 = 0"),
    _scoped("naming.negative-boolean", 7, "noCache"),
    _scoped("waste.unused-parameter", 7, "noCache"),
    _scoped("waste.unused-parameter", 7, "a", "p_partkey % 35 = 0"),
    _scoped("test-quality.trivial-assertion", 13, "testIt", "p_partkey % 2 = 1"),
    _scoped("test-quality.private-reflection", 14, "testIt", "p_partkey % 3 <> 0"),
    _scoped("test-quality.exception-type-only", 12, "testIt", "p_partkey % 2 = 0 AND p_partkey % 3 <> 0"),
    _scoped("test-quality.setup-bloat", 16, "setUp", "p_partkey % 13 = 0", "9"),
])
