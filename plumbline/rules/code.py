"""Lexical facts of source code, and rules over them.

A text is cut into comments, strings and other code by one regular expression; the
comments are blanked and the strings' contents masked, so that lines and columns
stay. All further facts are relations: lines with brace depth and running counts,
declarations with the line on which their block ends, references by name. Metrics
of a declaration are differences of running counts at its two ends.

These rules see words and braces, not syntax trees: what needs types, scopes of
variables or data flow is not offered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.sources.staging import staged

COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*+|#(?!\[)[^\n]*+"
STRING = r"'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'|\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\""
PIECE = rf"(?:{COMMENT})|(?:{STRING})|[^/#'\"]++|[\s\S]"
BRANCH = r"\b(?:if|elseif|for|foreach|while|catch|case|and|or|xor)\b|&&|\|\||\?\?|\?(?![?>:-])"
ASSERTION = r"(?:->|::)(?:assert\w*|fail|expect\w*)\s*\("
# fixed values: names and calls that the rules look for
CONFUSING = ("Data", "Info", "Manager", "Handler", "Helper", "Util", "Utils", "Service", "Processor", "Base", "Common", "Misc")
GENERIC = ("process", "handle", "execute", "run", "manage", "doit", "do", "perform", "make", "compute")
PLACEHOLDERS = ("foo", "bar", "baz", "tmp", "temp", "obj", "arr")
TYPE_PREFIXES = "str|int|float|bool|arr|obj|fn|cls"
COUNTERS = ("i", "j", "k", "n", "x", "y", "z", "e", "_")
CALLS = {
    "security.dangerous-function-call": r"(?<![>:\w$\\])(?:exec|passthru|popen|proc_open|shell_exec|system|eval)\s*\(",
    "security.insecure-random": r"(?<![>:\w$\\])(?:lcg_value|mt_rand|rand)\s*\(",
    "security.weak-crypto": r"(?<![>:\w$\\])(?:md5|sha1|mcrypt_\w+)\s*\(",
    "security.error-suppression": r"(?<![\w@])@\s*[$\w\\]",
    "modernisation.forbidden-global-access": r"\$_(?:GET|POST|SESSION)\b",
}
LIMITS = {"size.class-length": 1000, "size.file-length": 1000, "size.parameter-count": 10, "size.property-count": 15, "size.public-method-count": 25, "size.average-method-length": 50, "complexity.cyclomatic": 20, "complexity.nesting-depth": 4, "test-quality.test-method-too-long": 25}


def pieces(units: DataFrame) -> DataFrame:
    """file and the comments, strings and code of each text, in order."""
    return units.select("file", F.regexp_extract_all("source", F.lit(PIECE), F.lit(0)).alias("pieces"))


def masked(units: DataFrame) -> DataFrame:
    """file, source, and code: the source with blank comments and masked strings."""
    def blank(p: Column) -> Column:
        inner = F.regexp_replace(F.substring(p, F.lit(2), F.length(p) - 2), r"[^\n]", "_")
        quoted = F.concat(F.substring(p, 1, 1), inner, F.substring(p, 1, 1))
        return F.when(p.rlike(r"^(?:/\*|//|#(?!\[))"), F.regexp_replace(p, r"[^\n]", " ")).when(p.rlike(r"^['\"]") & (F.length(p) > 1), quoted).otherwise(p)

    cut = units.select("file", "source", F.regexp_extract_all("source", F.lit(PIECE), F.lit(0)).alias("_pieces"))
    return cut.select("file", "source", F.array_join(F.transform("_pieces", blank), "").alias("code"))


def code_lines(units: DataFrame) -> DataFrame:
    """file, line, raw, code, depth before, after and at its peak, and running counts of solid lines, branches and assertions."""
    both = F.arrays_zip(F.split("source", "\n").alias("raw"), F.split("code", "\n").alias("code"))
    rows = masked(units).select("file", F.posexplode(both).alias("at", "x")).select("file", (F.col("at") + 1).alias("line"), F.col("x.raw").alias("raw"), F.col("x.code").alias("code"))
    w = Window.partitionBy("file").orderBy("line")
    n = lambda p: F.size(F.regexp_extract_all("code", F.lit(p), F.lit(0)))
    doc = F.when((F.trim("raw") != "") & ~F.col("raw").rlike(r"^\s*#\["), F.col("raw"))
    rows = rows.withColumn("opens", n(r"\{")).withColumn("closes", n(r"\}")).withColumn("depth", F.sum(F.col("opens") - F.col("closes")).over(w))
    rows = rows.withColumn("before", F.col("depth") - F.col("opens") + F.col("closes"))
    rows = rows.withColumn("peak", F.col("before") + F.length(F.regexp_replace(F.regexp_extract("code", r"^[^}]*", 0), r"[^{]", "")))
    rows = rows.withColumn("solid", F.sum((F.trim("code") != "").cast("int")).over(w)).withColumn("branches", F.sum(n(BRANCH)).over(w)).withColumn("assertions", F.sum(n(ASSERTION)).over(w))
    return rows.withColumn("above", F.last(doc, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def declarations(lines: DataFrame) -> DataFrame:
    """file, kind, name, start, end, depth, visibility, documented, header: classes, methods and functions.

    The end is the next line on which a block of the same depth closes.
    """
    code = F.col("code")
    class_like = F.regexp_extract(code, r"(?<![:\w$])(class|interface|trait|enum)\s+\w+", 1)
    function = F.regexp_extract(code, r"\bfunction\s+&?\s*(\w+)\s*\(", 1)
    visibility = F.regexp_extract(code, r"\b(public|protected|private)\b", 1)
    found = lines.where((class_like != "") | (function != ""))
    found = found.select(
        "file", F.when(class_like != "", class_like).when(F.col("before") > 0, "method").otherwise("function").alias("kind"),
        F.when(class_like != "", F.regexp_extract(code, r"(?<![:\w$])(?:class|interface|trait|enum)\s+(\w+)", 1)).otherwise(function).alias("name"),
        F.col("line").alias("start"), F.col("before").alias("at"), F.when(visibility != "", visibility).otherwise("public").alias("visibility"),
        F.coalesce(F.col("above").rlike(r"\*/\s*$"), F.lit(False)).alias("documented"), code.alias("header"), (F.col("code").rlike(r";\s*$") & (F.col("opens") == 0)).alias("bodyless"),
    )
    closers = lines.where("closes > 0").select("file", "line", F.explode(F.sequence(F.col("depth"), F.greatest("depth", F.col("before")))).alias("at")).select("file", "at", F.col("line").alias("closed"))
    both = found.withColumn("closed", F.lit(None).cast("int")).unionByName(closers, allowMissingColumns=True)
    place = Window.partitionBy("file", "at").orderBy(F.desc(F.coalesce("start", "closed")), F.col("closed").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)  # from the end: one pass
    ended = both.withColumn("end", F.last("closed", ignorenulls=True).over(place)).where("start is not null")
    return ended.select("file", "kind", "name", "start", F.when(F.col("bodyless"), F.col("start")).otherwise(F.coalesce("end", "start")).alias("end"), F.col("at").alias("depth"), "visibility", "documented", "header", "bodyless")


def measured(lines: DataFrame, decls: DataFrame) -> DataFrame:
    """declarations with m_solid, m_branches, m_assertions between their ends, by two equi-joins."""
    counts = ("solid", "branches", "assertions")
    first = lines.select(F.col("file").alias("_f"), (F.col("line") + 1).alias("_s"), *[F.col(c).alias(f"{c}0") for c in counts])
    last = lines.select(F.col("file").alias("_g"), F.col("line").alias("_e"), *[F.col(c).alias(f"{c}1") for c in counts])
    out = decls.join(first, (F.col("file") == F.col("_f")) & (F.col("start") == F.col("_s")), "left").join(last, (F.col("file") == F.col("_g")) & (F.col("end") == F.col("_e")))
    return out.select(*decls.columns, *[(F.col(f"{c}1") - F.coalesce(f"{c}0", F.lit(0))).alias(f"m_{c}") for c in counts])


#: Lines of a bucket in which lines meet what spans them.
BUCKET = 64


def cut(spans: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """spans with a row for each bucket of lines that they touch."""
    return spans.withColumn("_cut", F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET))))


def bucket(line: str) -> Column:
    return F.floor(F.col(line) / BUCKET)


def members(decls: DataFrame) -> DataFrame:
    """Methods with the class that they stand in: class_name, class_kind, class_start."""
    c = decls.where("kind in ('class', 'interface', 'trait', 'enum')").select(F.col("file").alias("_file"), F.col("name").alias("class_name"), F.col("kind").alias("class_kind"), F.col("start").alias("class_start"), F.col("end").alias("_end"), (F.col("depth") + 1).alias("_depth"))
    inside = (F.col("file") == F.col("_file")) & (F.col("_at") == F.col("_cut")) & (F.col("depth") == F.col("_depth")) & (F.col("start") > F.col("class_start")) & (F.col("end") <= F.col("_end"))
    return decls.where("kind = 'method'").withColumn("_at", bucket("start")).join(cut(c, "class_start", "_end"), inside).drop("_file", "_end", "_depth", "_at", "_cut")


def _report(rows: DataFrame, rules: dict[str, tuple[Column, Column | None]], line: str = "start", symbol: str | None = "name") -> DataFrame:
    """One pass over rows for several rules: file, line, rule_id, symbol, value for each condition that holds."""
    none = F.lit(None).cast("long")
    hits = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule_id"), (none if value is None else value.cast("long")).alias("value"))) for rule, (test, value) in rules.items()]))
    each = rows.select("file", F.col(line).cast("int").alias("line"), (F.col(symbol) if symbol else F.lit(None).cast("string")).alias("symbol"), F.inline(hits))
    return each.select("file", "line", "rule_id", "symbol", "value")


def _over(limits: dict[str, float], rule: str, value: Column, where: Column | None = None) -> dict[str, tuple[Column, Column]]:
    return {rule: ((value > limits[rule]) if where is None else where & (value > limits[rule]), value)}


def code_findings(units: DataFrame, lines: DataFrame | None = None, decls: DataFrame | None = None, limits: dict[str, float] | None = None) -> DataFrame:
    """file, line, rule_id, symbol, value of all lexical rules on code units.

    Lines and measured declarations are staged once; each of the passes below
    evaluates all rules that need the same rows.
    """
    code, text, limits = F.col("code"), units.select("file", "source"), LIMITS | (limits or {})
    lines = lines or staged(code_lines(text), "code-lines")
    decls = decls or staged(measured(lines, declarations(lines)), "code-declarations")
    methods = members(decls)
    is_class, is_callable, name = F.col("kind").isin("class", "interface", "trait", "enum"), F.col("kind").isin("method", "function"), F.col("name")
    empty = (F.col("end") == F.col("start")) & F.col("header").rlike(r"\{\s*\}")
    parameters = F.size(F.filter(F.split(F.regexp_replace(F.regexp_extract("header", r"\bfunction\s+&?\s*\w+\s*\(((?:[^()]++|\([^()]*+\))*+)", 1), r"\([^()]*\)", ""), ","), lambda x: F.trim(x) != ""))
    out = [_report(lines, {rule: (code.rlike(p), None) for rule, p in CALLS.items()} | {"security.silent-catch": (code.rlike(r"\bcatch\s*\([^)]*\)\s*\{\s*\}"), None)}, "line", None)]
    out.append(_report(decls, {
        **_over(limits, "size.class-length", F.col("m_solid"), is_class & (F.col("kind") != "interface")),
        **_over(limits, "size.parameter-count", parameters, is_callable),
        **_over(limits, "complexity.cyclomatic", F.col("m_branches") + 1, is_callable & ~F.col("bodyless")),
        "docs.missing-class-phpdoc": (is_class & ~F.col("documented"), None),
        "naming.confusing-name": (is_class & name.isin(*CONFUSING), None),
        "naming.generic-method": (is_callable & F.lower("name").isin(*GENERIC), None),
        "waste.empty-method": (is_callable & empty, None),
        "waste.empty-class": (is_class & empty & ~F.col("header").rlike(r"\bextends\s+\w*(?:Exception|Throwable)\b"), None),
    }))
    # methods in their class, and classes by their methods
    is_test = F.col("class_name").rlike("Tests?$") & name.rlike("^test")
    out.append(_report(methods, {"docs.missing-public-phpdoc": (~F.col("documented"), None), "test-quality.no-assertions": (is_test & (F.col("m_assertions") == 0), None), **_over(limits, "test-quality.test-method-too-long", F.col("m_solid") - 2, is_test)}))
    snake = F.substring("name", 5, 1 << 20).contains("_")
    per_class = methods.groupBy("file", "class_name", "class_start", "class_kind").agg(F.count_if(F.col("visibility") == "public").alias("n_public"), F.sum("m_solid").alias("total"), F.count("*").alias("n"), F.count_if(is_test).alias("n_tests"), F.count_if(is_test & snake).alias("n_snake"))
    out.append(_report(per_class, {
        **_over(limits, "size.public-method-count", F.col("n_public"), F.col("class_kind").isin("class", "enum")),
        **_over(limits, "size.average-method-length", F.floor(F.col("total") / F.col("n")), F.col("class_kind") != "interface"),
        "naming.test-naming-consistency": ((F.col("n_tests") >= 2) & (F.col("n_snake") > 0) & (F.col("n_snake") < F.col("n_tests")), None),
    }, "class_start", "class_name"))
    stem = F.regexp_extract("file", r"([^/]+)\.php$", 1)
    solo = decls.where(is_class).groupBy("file").agg(F.count("*").alias("n"), F.first("name").alias("name"), F.min("start").alias("start"))
    out.append(_report(solo, {"naming.class-file-mismatch": ((F.col("n") == 1) & stem.rlike(r"^[A-Za-z_]\w*$") & (stem != name), None)}))
    # lines inside callables
    within = lines.select(F.col("file").alias("_file"), bucket("line").alias("_at"), F.col("line").alias("_line"), F.greatest("depth", "peak").alias("_depth"), F.col("code").alias("_code"))
    inside = (F.col("file") == F.col("_file")) & (F.col("_cut") == F.col("_at")) & (F.col("_line") >= F.col("start")) & (F.col("_line") <= F.col("end"))
    nested = cut(decls.where(is_callable)).join(within, inside).groupBy("file", "name", "start", "depth").agg((F.max("_depth") - F.first("depth") - 1).alias("m_depth"))
    out.append(_report(nested, _over(limits, "complexity.nesting-depth", F.col("m_depth"))))
    bodies = cut(methods.where(is_test)).join(within, inside & (F.col("_line") > F.col("start")) & (F.col("_line") < F.col("end")))
    out.append(_report(bodies, {
        "test-quality.sleep-in-test": (F.col("_code").rlike(r"(?<![\w>:$])(?:sleep|usleep|time_nanosleep)\s*\("), None),
        "test-quality.conditional-logic": (F.col("_code").rlike(r"\bif\s*\("), None),
        "test-quality.skipped-without-reason": (F.col("_code").rlike(r"\bmarkTestSkipped\s*\(\s*(?:\)|['\"]{2})"), None),
    }, "_line"))
    # properties and constants of classes
    field = r"^\s*(?:public|protected|private|var)\s+(?:static\s+|readonly\s+)*(?:\??[\w\\|]+\s+)?\$(\w+)"
    constant = r"^\s*(?:(?:public|protected|private|final)\s+)*const\s+(?:\w+\s+)?(\w+)\s*="
    at_class = decls.where(is_class).select(F.col("file").alias("_file"), F.col("name").alias("class_name"), F.col("start").alias("class_start"), F.col("end").alias("_end"), (F.col("depth") + 1).alias("_depth"))
    held = lines.withColumn("is_field", code.rlike(field)).where(F.col("is_field") | code.rlike(constant)).withColumn("name", F.when(F.col("is_field"), F.regexp_extract("code", field, 1)).otherwise(F.regexp_extract("code", constant, 1)))
    held = held.withColumn("_at", bucket("line")).join(cut(at_class, "class_start", "_end"), (F.col("file") == F.col("_file")) & (F.col("_at") == F.col("_cut")) & (F.col("before") == F.col("_depth")) & (F.col("line") > F.col("class_start")) & (F.col("line") <= F.col("_end"))).drop("_file")
    bare = ~F.coalesce(F.col("above").rlike(r"\*/\s*$"), F.lit(False))
    out.append(_report(held, {"docs.missing-property-phpdoc": (F.col("is_field") & bare, None), "docs.missing-constant-phpdoc": (~F.col("is_field") & bare, None), "modernisation.public-property": (F.col("is_field") & code.rlike(r"^\s*public\s+(?!static|readonly)"), None)}, "line"))
    out.append(_report(held.where("is_field").groupBy("file", "class_name", "class_start").agg(F.count("*").alias("n")), _over(limits, "size.property-count", F.col("n")), "class_start", "class_name"))
    # private members without a reference by name in their file
    private = methods.where((F.col("visibility") == "private") & ~name.startswith("__")).select("file", F.col("start").alias("line"), "name", F.lit("method").alias("what"))
    private = private.unionByName(held.where(code.rlike(r"^\s*private\b")).select("file", "line", "name", F.when(F.col("is_field"), "property").otherwise("constant").alias("what")))
    refs = lines.select(F.col("file").alias("_file"), F.explode(F.regexp_extract_all("code", F.lit(r"(?:->|::)\s*\$?(\w+)"), F.lit(1))).alias("_name")).distinct()
    unused = private.join(refs, (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")), "left_anti")
    out.append(_report(unused, {f"dead-code.unused-private-{what}": (F.col("what") == what, None) for what in ("method", "property", "constant")}, "line"))
    alias = F.coalesce(F.nullif(F.regexp_extract("code", r"\bas\s+(\w+)\s*;", 1), F.lit("")), F.regexp_extract("code", r"(\w+)\s*;", 1))
    imports = lines.where(code.rlike(r"^use\s+[\w\\]+(?:\s+as\s+\w+)?\s*;")).select("file", "line", alias.alias("name"))
    words = lines.where(~code.rlike(r"^use\s")).select(F.col("file").alias("_file"), F.explode(F.regexp_extract_all("raw", F.lit(r"\w+"), F.lit(0))).alias("_name")).distinct()
    out.append(_report(imports.join(words, (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")), "left_anti"), {"waste.unused-import": (F.lit(True), None)}, "line"))
    # names of variables, at their first line, and commented-out code
    names = lines.select("file", "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"\$(\w+)"), F.lit(1)))).alias("name")).groupBy("file", "name").agg(F.min("line").alias("start"))
    out.append(_report(names, {"naming.short-variable": ((F.length("name") == 1) & ~name.isin(*COUNTERS), None), "naming.hungarian-notation": (name.rlike(f"^(?:{TYPE_PREFIXES})[A-Z]"), None), "naming.identifier-quality": (F.lower("name").isin(*PLACEHOLDERS), None)}))
    is_comment = lambda p: p.rlike(r"^(?:/\*(?!\*)|//|#)") & (F.size(F.regexp_extract_all(p, F.lit(r"(?m);\s*$|\$\w+\s*=[^=]|\b(?:if|foreach|while)\s*\("), F.lit(0))) >= 2)
    comments = pieces(text).select("file", F.size(F.filter("pieces", is_comment)).alias("n"), F.lit(None).cast("int").alias("line"))
    out.append(_report(comments, {"waste.commented-out-code": (F.col("n") > 0, F.col("n"))}, "line", None))
    found = out[0]
    for rows in out[1:]:
        found = found.unionByName(rows)
    return found
