"""Rules on what names, signatures and comments promise: abbreviations, mixed types, reasons of asserted types, file comments, header pairs.

They read the lines and segments that other rules over code share. Where the lexical
definition differs from a syntax tree's: variables of an arrow function belong to the
callable around it; a header call is reported at the first line of its statement;
inline markup before the first tag is no statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.rules.statements import GROUP, STRUCTURAL, VEIL

# fixed values: abbreviations that need no reason
ACCEPTED = ("age", "app", "db", "dto", "fs", "id", "io", "key", "log", "max", "min", "now", "raw", "rx", "tx", "ui", "url", "utc")
WILDCARD = r"(?i)access-control-allow-origin\s*:\s*\*"
CREDENTIALS = r"(?i)access-control-allow-credentials\s*:\s*true"
HEADER_CALL = r"(?i)(?<![>:\w$\\])\\?header\s*\(\s*('[^']*'|\"[^\"$]*\")\s*[,)]"
FUNCTION = r"(?is)^(.*?)\bfunction\b"
MIXED = r"(?i)[,(]\s*(?:(?:public|protected|private|readonly)\s+)*\\?mixed\s+(?:&\s*)?(?:\.\.\.\s*)?(\$\w+)"
DECLARED = r"(?i)^\s*(?:static\s+)?(?:public|protected|private|var|abstract|final|readonly|const|class|interface|trait|enum)\b|^\s*(?:static\s+)?function\s+&?\s*\w+\s*\(|^\s*\??[\w\\|]+\s+(?:&\s*)?(?:\.\.\.)?\$\w+\s*(?:=[^;]*)?[,)]?\s*$"
BARE = r"^@var\b.*?\$([A-Za-z_\x{80}-\x{10FFFF}][A-Za-z0-9_\x{80}-\x{10FFFF}]*)\s*$"


def _rows(rows: DataFrame, rule: str, line: Column, symbol: Column | None = None, value: Column | None = None, detector: Column | None = None) -> DataFrame:
    none = F.lit(None)
    given = lambda c, t: (none if c is None else c).cast(t)
    return rows.select("file", line.cast("int").alias("line"), F.lit(rule).alias("rule_id"), given(symbol, "string").alias("symbol"), given(value, "long").alias("value"), given(detector, "string").alias("detector"))


def _heads(segments: DataFrame) -> DataFrame:
    """Heads of named functions, with a body or without, and of closures."""
    bodyless = (F.col("ender") == ";") & (F.col("block.kind") == "class") & F.col("body").rlike(r"(?i)\bfunction\s+&?\s*\w+\s*\(")
    return segments.where(F.coalesce(F.col("kind").isin("function", "closure"), F.lit(False)) | F.coalesce(bodyless, F.lit(False)))


def mixed_types(segments: DataFrame) -> DataFrame:
    """Public methods and functions with a mixed parameter or result; detector lists where, value counts it."""
    body = F.col("body")
    hidden = F.regexp_extract("body", FUNCTION, 1).rlike(r"(?i)\b(?:private|protected)\b")
    signature = F.regexp_extract("body", rf"(?i)\bfunction\s+&?\s*\w+\s*({GROUP})", 1)
    places = F.concat(F.regexp_extract_all(signature, F.lit(MIXED), F.lit(1)), F.when(body.rlike(r"(?i)\)\s*:\s*\\?mixed\s*$"), F.array(F.lit("return type"))).otherwise(F.array().cast("array<string>")))
    found = _heads(segments).where(~F.coalesce(F.col("kind") == "closure", F.lit(False)) & ~hidden).withColumn("places", places).where("size(places) > 0")
    return _rows(found, "modernisation.mixed-type-overuse", F.col("line"), F.regexp_extract("body", r"(?i)\bfunction\s+&?\s*(\w+)", 1), F.size("places"), F.array_join("places", ", "))


def header_pairs(segments: DataFrame) -> DataFrame:
    """Scopes that send a wildcard origin and allow credentials, both as literals; at the first wildcard."""
    calls = segments.where(F.col("body").rlike("(?i)header")).select("file", "line", F.coalesce("scope.seq", F.lit(-1)).alias("scope"), F.explode(F.regexp_extract_all("body", F.lit(HEADER_CALL), F.lit(1))).alias("sent"))
    calls = calls.withColumn("sent", F.translate("sent", VEIL, STRUCTURAL))
    both = calls.groupBy("file", "scope").agg(F.min(F.when(F.col("sent").rlike(WILDCARD), F.col("line"))).alias("line"), F.max(F.col("sent").rlike(CREDENTIALS)).alias("credentials"))
    return _rows(both.where("credentials and line is not null"), "security.permissive-cors", F.col("line"))


def _variables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?<!::)\$([A-Za-z_]\w*)"), F.lit(1))


def abbreviations(segments: DataFrame, accepted: tuple[str, ...] = ACCEPTED, shortest: int = 2, longest: int = 3) -> DataFrame:
    """Short lower-case names of properties, parameters and other variables that are not accepted, once a callable; detector is the name.

    Counters of for, variables of foreach and those that catch are exempt.
    """
    body, label = F.col("body"), F.coalesce("owner", F.concat(F.lit("closure@"), F.col("owner_line").cast("string")))
    owner = F.nullif(F.regexp_extract("body", r"(?i)\bfunction\s+&?\s*(\w+)", 1), F.lit(""))
    signature = F.regexp_extract("body", rf"(?i)\bfunction\s*&?\s*\w*\s*({GROUP})", 1)
    given = _heads(segments).select("file", F.col("seq").alias("at"), owner.alias("owner"), F.col("line").alias("owner_line"), "line", "seq", F.explode(_variables(signature)).alias("name"), F.lit(True).alias("given"), F.lit(False).alias("exempt"))
    used = segments.where("scope is not null").withColumn("text", F.when(F.coalesce(F.col("kind").isin("function", "closure"), F.lit(False)), F.regexp_extract("body", FUNCTION, 1)).otherwise(body))
    loops = F.concat(F.regexp_extract("body", r"(?is)\bforeach\s*\(.*\bas\b(.*)\)", 1), F.lit(" "), F.regexp_extract("body", r"(?i)\bcatch\s*\(([^)]*)\)", 1), F.lit(" "), F.regexp_extract("body", r"(?i)\bfor\s*\(([^,]*),", 1))
    used = used.select("file", F.col("scope.seq").alias("at"), F.nullif("scope.name", F.lit("")).alias("owner"), F.col("scope.line").alias("owner_line"), "line", "seq", F.array_distinct(_variables(F.col("text"))).alias("names"), _variables(loops).alias("exempts"))
    used = used.select("file", "at", "owner", "owner_line", "line", "seq", F.explode("names").alias("name"), F.lit(False).alias("given"), "exempts")
    used = used.withColumn("exempt", F.array_contains("exempts", F.col("name"))).drop("exempts")
    in_callables = given.unionByName(used).groupBy("file", "at", "owner", "owner_line", "name").agg(F.min_by("line", "seq").alias("line"), F.max("given").alias("given"), F.max("exempt").alias("exempt"))
    in_callables = in_callables.where("given or not exempt").select("file", "line", label.alias("symbol"), "name")
    field = F.col("body").rlike(r"(?i)^(?:#?\[[^\]]*\]\s*)*(?:(?:public|protected|private|var|static|readonly)\b\s*)+(?:\??[\w\\|&]+\s+)?\$") & (F.col("block.kind") == "class")
    fields = segments.where(field).select("file", "line", F.explode(_variables(body)).alias("name")).withColumn("symbol", F.concat(F.lit("$"), "name"))
    found = in_callables.unionByName(fields.select("file", "line", "symbol", "name"))
    found = found.where(F.col("name").rlike(f"^[a-z]{{{shortest},{longest}}}$") & (F.col("name") != "this") & ~F.col("name").isin(*[a.lower() for a in accepted]))
    return _rows(found, "naming.abbreviation-allowlist", F.col("line"), F.col("symbol"), detector=F.col("name"))


def file_comments(lines: DataFrame, declarations: DataFrame) -> DataFrame:
    """Files whose first statement (a namespace aside) has no comment block, unless their one class has one."""
    code = F.trim(F.regexp_replace("code", r"^\s*<\?(?:php\b|=)?", ""))
    statement = F.trim(F.regexp_replace(code, r"(?i)^namespace\b[^;{]*(?:[;{]|$)", ""))
    earlier = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.trim("code") != "", F.struct(F.col("line").alias("at"), (code == "").alias("tag"))), ignorenulls=True).over(earlier)
    first = lines.select("file", "line", "raw", "block_above", statement.alias("statement"), before.alias("before")).where("statement not in ('', '?>', '}')")
    first = first.groupBy("file").agg(F.min_by(F.struct("raw", "block_above", "before"), "line").alias("f")).select("file", "f.*")
    above = F.coalesce((F.col("block_above") > F.coalesce("before.at", F.lit(0))) | ((F.col("block_above") == F.col("before.at")) & F.col("before.tag")), F.lit(False))
    first = first.where(~above & ~F.col("raw").rlike(r"^\s*(?:<\?php\s+)?/\*\*"))
    braced = lines.where(code.rlike(r"(?i)^namespace\b[^;]*\{")).select("file", F.lit(1).alias("_top")).distinct()
    classes = declarations.where("kind in ('class', 'interface', 'trait', 'enum')").join(braced, "file", "left").where(F.col("depth") == F.coalesce("_top", F.lit(0)))
    told = classes.groupBy("file").agg(F.count("*").alias("n"), F.max("documented").alias("told")).where("n = 1 and told").select("file")
    return _rows(first.join(told, "file", "left_anti"), "docs.missing-file-phpdoc", F.lit(1), F.col("file"))


def asserted_types(lines: DataFrame) -> DataFrame:
    """Types asserted of variables in a comment block that gives no reason, unless the block belongs to a declaration; one for each variable."""
    later = Window.partitionBy("file").orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    solid = F.when((F.trim("code") != "") & ~F.col("raw").rlike(r"^\s*#\["), F.col("code"))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^.*?(?=/\*\*)", ""), r"\*/.*$", ""), r"^[\s/*]+|[\s/*]+$", "")
    rows = lines.withColumn("follows", F.coalesce(solid, F.last(solid, ignorenulls=True).over(later))).where("block is not null").select("file", "block", "line", said.alias("said"), "follows")
    blocks = rows.groupBy("file", "block").agg(
        F.max((F.col("said") != "") & ~F.col("said").startswith("@")).alias("prose"), F.max_by("follows", "line").alias("follows"),
        F.collect_list(F.when(F.col("said").rlike(BARE), F.regexp_extract("said", BARE, 1))).alias("bare"),
    )
    local = blocks.where(~F.col("prose") & ~F.coalesce(F.col("follows").rlike(DECLARED), F.lit(False)))
    return _rows(local.select("file", F.col("block").alias("line"), F.explode("bare").alias("name")), "docs.var-annotation-description", F.col("line"), F.concat(F.lit("$"), "name"))


def convention_findings(lines: DataFrame, declarations: DataFrame, segments: DataFrame, accepted: tuple[str, ...] = ACCEPTED) -> DataFrame:
    """file, line, rule_id, symbol, value, detector of the rules of this module, over the shared facts of code."""
    parts = (mixed_types(segments), header_pairs(segments), abbreviations(segments, accepted), file_comments(lines, declarations), asserted_types(lines))
    found = parts[0]
    for rows in parts[1:]:
        found = found.unionByName(rows)
    return found
