"""Flow of request data within a callable: an ordered fold over assignments and sinks.

Assignments and sinks of a callable are folded in source order with the set of tainted
variables. A plain assignment taints its variable if it reads request data or a
tainted variable, and clears it if not; ``.=`` never clears. A sink is found if its
argument reads either. Output sinks keep a second set, of what was not escaped on its way.

Outside callables only reads of request data itself count, but for output, which
follows variables there too. Closures are callables of their own. Nothing flows between
callables, through properties, elements, references or conditions with an
assignment inside; a named argument counts at the place where it stands.

A callable's assignments and sinks are one array while it is folded; callables
without a sink are left out before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.asof import last_before
from plumbline.rules.statements import GROUP, STRUCTURAL, VEIL, segments
from plumbline.sources.staging import staged

# fixed values: request data, and the calls that the rules look for with the places of their arguments
REQUEST = r"\$_(?:GET|POST|REQUEST|COOKIE|SERVER|FILES)\b"
PATH_ARGUMENTS = {"chdir": (0,), "copy": (0, 1), "file_get_contents": (0,), "file_put_contents": (0,), "fopen": (0,), "glob": (0,), "mkdir": (0,), "readfile": (0,), "realpath": (0,), "rename": (0, 1), "rmdir": (0,), "scandir": (0,), "unlink": (0,)}
SHELLS = ("exec", "passthru", "popen", "proc_open", "shell_exec", "system")
LOG_FUNCTIONS = ("error_log", "print_r", "var_dump")
LOG_METHODS = ("alert", "critical", "debug", "emergency", "error", "info", "log", "notice", "warning")
HTTP_METHODS = ("delete", "get", "head", "patch", "post", "put", "request", "send")
ESCAPERS = ("htmlspecialchars", "htmlentities", "e", "urlencode", "rawurlencode", "intval", "floatval", "boolval")
QUERY_METHODS = ("exec", "query", "raw", "select")
QUERY_FUNCTIONS = {"mysql_query": 0, "mysqli_query": 1, "pg_query": 1, "sqlsrv_query": 1, "oci_parse": 1}
#: Own definition: parts of names that say that a value is secret, files by object, statement words of SQL.
SENSITIVE = r"(?i)(?:passw(?:or)?d|secret|token|api_?key|private_?key|credential|authorization|cookie)"
FILE_CLASSES = "SplFileObject|SplFileInfo|DirectoryIterator|FilesystemIterator|RecursiveDirectoryIterator|GlobIterator"
XML_CLASSES = "DOMDocument|SimpleXMLElement|XMLReader"
SQL_WORDS = r"(?i)['\"]\s*(?:SELECT|INSERT|UPDATE|DELETE|REPLACE|MERGE|CREATE|DROP|ALTER|TRUNCATE|WITH)\b"

ARGUMENT = r"(?:[^,()\[\]]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)|\[(?:[^\[\]]|\[[^\[\]]*\])*\])+"
NOT_A_METHOD = r"(?<![\w$>:\\])"
URL = rf"(?i)['\"]https?{VEIL[STRUCTURAL.index(':')]}//"
INTERPOLATED = r'"[^"]*\$\w|\.\s*\(?\s*\$\w|^\s*\$\w[^"\']*\.'


def calls(text: Column, head: str) -> Column:
    """The calls in a text whose name and what stands before it match ``head``, whole."""
    return F.regexp_extract_all(text, F.lit(rf"(?:{head})\s*{GROUP}"), F.lit(0))


def argument(call: Column, i: int) -> Column:
    """The argument of a call at a place, without its label; null where there is none."""
    inside = F.regexp_extract(call, r"\(([\s\S]*)\)$", 1)
    return F.regexp_replace(F.get(F.regexp_extract_all(inside, F.lit(ARGUMENT), F.lit(0)), F.lit(i)), r"^\s*\w+\s*:(?!:)\s*", "")


def assignments(rows: DataFrame) -> DataFrame:
    """file, scope (its head's seq, -1 outside callables), symbol, seq, line, variable, appends, value: statements that assign to a local variable."""
    pattern = r"^(?:(?:case\b(?:[^:]|::)*:(?!:)|default\s*:)\s*)?\$(\w+)\s*(\.?)=(?![=>])\s*([\s\S]*)$"
    part = lambda i: F.regexp_extract("body", pattern, i)
    return rows.where(F.col("body").rlike(pattern)).select("file", F.coalesce("scope.seq", F.lit(-1)).alias("scope"), F.col("scope.name").alias("symbol"), "seq", "line", part(1).alias("variable"), (part(2) == ".").alias("appends"), part(3).alias("value"))


def _sinks(rows: DataFrame) -> Column:
    """Every sink of a segment: rule, the text that must not be tainted, and whether it is found in any case."""
    body, none = F.col("body"), F.array().cast("array<struct<rule:string,value:string,always:boolean>>")

    def each(found: Column, rule: str, places, unless: str | None = None, only: str | None = None, always: str | None = None) -> Column:
        def one(call, i):
            value = argument(call, i)
            fits = value.isNotNull() & (F.lit(True) if unless is None else ~value.rlike(unless)) & (F.lit(True) if only is None else value.rlike(only))
            return F.when(fits, F.struct(F.lit(rule).alias("rule"), value.alias("value"), (F.lit(False) if always is None else value.rlike(always)).alias("always")))
        return F.flatten(F.transform(found, lambda call: F.array_compact(F.array(*[one(call, i) for i in places]))))

    named = lambda *names: rf"(?i){NOT_A_METHOD}(?:{'|'.join(names)})"
    out = [each(calls(body, named("extract", "compact")), "security.extract-compact-user-input", (0,)), each(calls(body, named("header")), "security.header-injection", (0,))]
    one, two = [n for n, p in PATH_ARGUMENTS.items() if p == (0,)], [n for n, p in PATH_ARGUMENTS.items() if p == (0, 1)]
    path = "security.path-traversal-file-access"
    out += [each(calls(body, named(*one)), path, (0,), unless=URL), each(calls(body, named(*two)), path, (0, 1), unless=URL), each(calls(body, rf"\bnew\s+\\?(?:{FILE_CLASSES})"), path, (0,), unless=URL)]
    shell = "security.process-command-construction"
    out += [each(calls(body, named(*SHELLS)), shell, (0,), always=INTERPOLATED), each(calls(body, r"\bnew\s+\\?(?:\w+\\)*Process|\bProcess::fromShellCommandline"), shell, (0,))]
    out.append(F.transform(F.regexp_extract_all(body, F.lit(r"`[^`]*`"), F.lit(0)), lambda x: F.struct(F.lit(shell).alias("rule"), x.alias("value"), F.lit(False).alias("always"))))
    url = "security.request-controlled-url"
    out += [each(calls(body, named("curl_init")), url, (0,)), each(F.filter(calls(body, named("curl_setopt")), lambda c: argument(c, 1).rlike(r"^\s*CURLOPT_URL\s*$")), url, (2,)), each(calls(body, named("file_get_contents", "fopen", "readfile")), url, (0,), only=URL)]
    http = calls(body, rf"(?i)->(?:{'|'.join(HTTP_METHODS)})")
    out += [each(F.filter(http, lambda c: ~F.lower(c).startswith("->request")), url, (0,), only=URL), each(F.filter(http, lambda c: F.lower(c).startswith("->request")), url, (1,), only=URL)]
    log, secret = "security.sensitive-data-logging", rf"(?:\$|->)\w*{SENSITIVE}"
    out += [each(calls(body, named(*LOG_FUNCTIONS)), log, (0,), always=secret), each(calls(body, rf"(?i)\w*log(?:ger)?(?:\(\))?->(?:{'|'.join(LOG_METHODS)})"), log, (0, 1), always=secret)]
    out.append(each(calls(body, r"(?i)->extractTo"), "security.unsafe-archive-extraction", (0, 1)))
    xml = "security.unsafe-xml-loading"
    guarded = lambda found: F.filter(found, lambda c: ~c.contains("LIBXML_NONET"))
    out += [each(guarded(calls(body, named("simplexml_load_file", "simplexml_load_string"))), xml, (0,)), each(guarded(calls(body, rf"\bnew\s+\\?SimpleXMLElement|\b(?:{XML_CLASSES})::(?:load|loadXML|open|xml)")), xml, (0,))]
    out.append(F.when(F.col("xml_class").isNotNull(), each(guarded(calls(body, r"\$\w+->(?:load|loadXML|open|xml)")), xml, (0,))).otherwise(none))
    shown = F.regexp_extract(body, r"(?i)^(?:echo|print)\b([\s\S]*)$", 1)
    plain = lambda value: F.struct(F.lit("security.reflected-xss").alias("rule"), value.alias("value"), F.lit(False).alias("always"))
    out += [F.when(shown != "", F.array(plain(shown))).otherwise(none), F.transform(calls(body, named("printf", "vprintf")), plain)]
    return F.concat(*out)


def _unescaped(text: Column) -> Column:
    """A text without what escapers and numeric casts take."""
    found = F.regexp_replace(text, rf"(?i){NOT_A_METHOD}(?:{'|'.join(ESCAPERS)})\s*{GROUP}", " ")
    return F.regexp_replace(found, r"(?i)\(\s*(?:int|integer|float|double|bool|boolean)\s*\)\s*\$\w+(?:\[[^\]]*\]|->\w+)*", " ")


def _reads(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\$(\w+)"), F.lit(1)))


def flow_events(rows: DataFrame) -> DataFrame:
    """file, scope, symbol, seq, line and target, appends or rule of each assignment and sink, with what it reads."""
    given = assignments(rows)
    # receivers of XML methods: the class that the variable was last given in its scope
    receiver = F.regexp_extract("body", r"(?i)\$(\w+)->(?:load|loadXML|open|xml)\s*\(", 1)
    rows = rows.withColumn("scope_seq", F.coalesce("scope.seq", F.lit(-1)))
    uses = rows.where(receiver != "").select("file", F.col("scope_seq").alias("scope"), "seq", receiver.alias("variable"))
    kinds = given.where("not appends").select("file", "scope", "seq", "variable", F.regexp_extract("value", rf"^new\s+\\?({XML_CLASSES})\b", 1).alias("xml_class"))
    typed = last_before(uses, kinds, ("file", "scope", "variable"), "seq", ("xml_class",)).where("xml_class <> ''").select(F.col("file").alias("_file"), F.col("seq").alias("_seq"), "xml_class")
    rows = rows.join(typed, (F.col("file") == F.col("_file")) & (F.col("seq") == F.col("_seq")), "left")
    sinks = rows.select("file", F.col("scope_seq").alias("scope"), F.col("scope.name").alias("symbol"), "seq", "line", F.explode(_sinks(rows)).alias("s")).select("file", "scope", "symbol", "seq", "line", F.lit(None).cast("string").alias("target"), F.lit(False).alias("appends"), F.col("s.rule").alias("rule"), F.col("s.value").alias("value"), F.col("s.always").alias("always"))
    both = sinks.unionByName(given.select("file", "scope", "symbol", "seq", "line", F.col("variable").alias("target"), "appends", F.lit(None).cast("string").alias("rule"), "value", F.lit(False).alias("always")))
    raw = _unescaped(F.col("value"))
    inside = F.when(F.col("scope") >= 0, _reads(F.col("value"))).otherwise(F.array().cast("array<string>"))
    return both.select("file", "scope", "symbol", "seq", "line", "target", "appends", "rule", (F.col("always") | F.col("value").rlike(REQUEST)).alias("direct"), inside.alias("reads"), raw.rlike(REQUEST).alias("raw_direct"), _reads(raw).alias("raw_reads"))


def taint_findings(events: DataFrame) -> DataFrame:
    """file, line, rule_id, symbol of the sinks that request data reaches: one a statement and rule."""
    packed = F.struct("seq", F.col("target").isNotNull().alias("later"), "line", "target", "appends", "rule", "direct", "reads", "raw_direct", "raw_reads")
    scopes = events.groupBy("file", "scope", "symbol").agg(F.array_sort(F.collect_list(packed)).alias("events"), F.count("rule").alias("sinks")).where("sinks > 0")
    names, found = F.array().cast("array<string>"), F.array().cast("array<struct<line:int,rule:string>>")

    def step(state, e):
        tainted, raw = e["direct"] | F.arrays_overlap(e["reads"], state["tainted"]), e["raw_direct"] | F.arrays_overlap(e["raw_reads"], state["raw"])
        gives = e["target"].isNotNull()
        after = lambda held, hit: F.when(gives & hit, F.array_union(held, F.array(e["target"]))).when(gives & ~e["appends"], F.array_remove(held, e["target"])).otherwise(held)
        hit = ~gives & F.when(e["rule"] == "security.reflected-xss", raw).otherwise(tainted)
        return F.struct(after(state["tainted"], tainted).alias("tainted"), after(state["raw"], raw).alias("raw"), F.when(hit, F.array_append(state["found"], F.struct(e["line"].cast("int").alias("line"), e["rule"].alias("rule")))).otherwise(state["found"]).alias("found"))

    folded = scopes.select("file", "symbol", F.aggregate("events", F.struct(names.alias("tainted"), names.alias("raw"), found.alias("found")), step, lambda s: s["found"]).alias("found"))
    return folded.select("file", "symbol", F.explode("found").alias("x")).select("file", F.col("x.line").alias("line"), F.col("x.rule").alias("rule_id"), "symbol").distinct()


def value_findings(rows: DataFrame, safe_receivers: tuple[str, ...] = ("wpdb",)) -> DataFrame:
    """file, line, rule_id, symbol of queries put together from variables and of included paths that are not fixed."""
    given = assignments(rows)
    body, safe = F.col("body"), "|".join(safe_receivers)
    methods = F.transform(calls(body, rf"(?i)(?:->|::)(?:{'|'.join(QUERY_METHODS)})"), lambda c: argument(c, 0))
    functions = [F.transform(calls(body, rf"(?i){NOT_A_METHOD}{name}"), lambda c, i=i: argument(c, i)) for name, i in QUERY_FUNCTIONS.items()]
    place = ("file", "scope", "symbol", "seq", "line")
    at = lambda: ("file", F.coalesce("scope.seq", F.lit(-1)).alias("scope"), F.col("scope.name").alias("symbol"), "seq", "line")
    queries = rows.select(*at(), F.explode(F.concat(methods, *functions)).alias("query")).where("query is not null")
    queries = queries.withColumn("variable", F.regexp_extract("query", r"^\s*\$(\w+)\s*$", 1))
    known = last_before(queries.where("variable <> ''"), given.where("not appends").select("file", "scope", "variable", "seq", "value"), ("file", "scope", "variable"), "seq", ("value",))
    texts = queries.where("variable = ''").select(*place, F.col("query").alias("text")).unionByName(known.where("value is not null").select(*place, F.col("value").alias("text")))
    dynamic = F.regexp_replace("text", rf"\$(?:this->)?(?:{safe})\b(?:->\w+)?", "")
    sql = texts.where(F.col("text").rlike(SQL_WORDS) & dynamic.rlike(INTERPOLATED)).select("file", "line", F.lit("security.sql-concatenation").alias("rule_id"), "symbol")
    fixed = r"^(?:\s*(?:'[^']*'|\"[^\"$]*\"|__\w+__|[A-Z][A-Z0-9_]*\b|dirname\s*" + GROUP + r"|[.()]))+\s*$"
    paths = rows.select(*at(), F.regexp_extract("body", r"(?i)(?<![\w$>:])(?:include|require)(?:_once)?\b\s*\(?\s*([\s\S]*?)\)?\s*$", 1).alias("path")).where("path <> ''")
    paths = paths.where(~F.col("path").rlike(fixed)).withColumn("name", F.regexp_extract("path", r"^\$(\w+)$", 1))
    always = given.groupBy(F.col("file").alias("_file"), F.col("scope").alias("_scope"), F.col("variable").alias("_name")).agg(F.bool_and(F.col("value").rlike(fixed)).alias("fixed")).where("fixed")
    open_ = paths.join(always, (F.col("file") == F.col("_file")) & (F.col("scope") == F.col("_scope")) & (F.col("name") == F.col("_name")), "left_anti")
    return sql.unionByName(open_.select("file", "line", F.lit("security.variable-include").alias("rule_id"), "symbol")).distinct()


def flow_findings(units: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """file, line, rule_id, symbol of all rules over flow on code units."""
    rows = rows or staged(segments(units.select("file", "source")), "flow-segments")
    return taint_findings(flow_events(rows)).unionByName(value_findings(rows))
