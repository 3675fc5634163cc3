"""Classes of a file, what they inherit from within it, and the rule that needs to know.

Parents are met by name level by level: each level joins what was found last with the
direct parents, and leaves out pairs that are known, so that a cycle ends and the number
of joins is the length of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.rules.statements import GROUP, is_statement
from plumbline.sources.staging import staged

#: Names whose meaning is the method, factories aside; a definition of our own.
SEMANTIC = r"^(?:__\w+|(?:is|has|can|should|get|set|with|to|from|as|create|make|of|test)(?:[A-Z_]\w*)?)$"


def classes(rows: DataFrame) -> DataFrame:
    """file, seq, name, kind, is_abstract, parents (names without namespace) of the classes, interfaces, traits and enums among segments."""
    head = F.col("body")
    named = F.regexp_extract(head, r"(?i)\b(?:extends|implements)\b([\s\S]*)$", 1)
    parents = F.transform(F.regexp_extract_all(F.regexp_replace(named, r"(?i)\b(?:extends|implements)\b", ","), F.lit(r"[\w\\]+"), F.lit(0)), lambda x: F.element_at(F.split(x, r"\\"), -1))
    kind = F.lower(F.regexp_extract(head, r"(?i)(?<![:\w$>])(class|interface|trait|enum)\b", 1))
    return rows.where("kind = 'class'").select("file", "seq", F.regexp_extract(head, r"(?i)(?:class|interface|trait|enum)\s+(\w+)", 1).alias("name"), kind.alias("kind"), head.rlike(r"(?i)\babstract\s").alias("is_abstract"), F.array_distinct(parents).alias("parents")).where("name <> ''")


def used_traits(rows: DataFrame) -> DataFrame:
    """file, name, parent: traits that a class uses."""
    uses = rows.where((F.col("block.kind") == "class") & F.col("body").rlike(r"^use\s+[\w\\]"))
    names = F.transform(F.regexp_extract_all("body", F.lit(r"(?:^use\s+|,\s*)([\w\\]+)"), F.lit(1)), lambda x: F.element_at(F.split(x, r"\\"), -1))
    return uses.select("file", F.col("block.name").alias("name"), F.explode(names).alias("parent"))


def ancestors(rows: DataFrame, most_levels: int = 50) -> DataFrame:
    """file, name, ancestor, distance: every class of the same file that a class inherits from, directly or not."""
    known_names = classes(rows).select("file", F.col("name").alias("parent")).distinct()
    direct = classes(rows).select("file", "name", F.explode("parents").alias("parent")).unionByName(used_traits(rows)).join(known_names, ["file", "parent"], "left_semi").distinct()
    direct = staged(direct.select("file", "name", "parent"), "class-parents")
    up = direct.select(F.col("file").alias("_file"), F.col("name").alias("_name"), F.col("parent").alias("_parent"))
    known = last = direct.select("file", "name", F.col("parent").alias("ancestor"), F.lit(1).alias("distance"))
    for distance in range(2, most_levels + 1):
        further = last.join(up, (F.col("file") == F.col("_file")) & (F.col("ancestor") == F.col("_name"))).select("file", "name", F.col("_parent").alias("ancestor")).distinct()
        last = staged(further.join(known.select("file", "name", "ancestor"), ["file", "name", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)), "class-ancestors")
        if last.isEmpty():
            return known
        known = known.unionByName(last)
    raise ValueError(f"a chain of more than {most_levels} classes")


def methods(rows: DataFrame) -> DataFrame:
    """file, class_name, name, line, seq, head, has_body of the methods of named classes."""
    inside = rows.where((F.col("block.kind") == "class") & F.col("block.name").isNotNull() & F.col("body").rlike(r"(?i)\bfunction\s+&?\s*\w+\s*\("))
    return inside.select("file", F.col("block.name").alias("class_name"), F.regexp_extract("body", r"(?i)\bfunction\s+&?\s*(\w+)", 1).alias("name"), "line", "seq", F.col("body").alias("head"), (F.col("ender") == "{").alias("has_body"))


def contract_methods(rows: DataFrame) -> DataFrame:
    """file, class_name, name: methods that an ancestor in the same file declares too."""
    own = methods(rows).select("file", "class_name", "name").distinct()
    above = own.select(F.col("file").alias("_file"), F.col("class_name").alias("_class"), F.lower("name").alias("_name"))
    told = ancestors(rows).join(above, (F.col("file") == F.col("_file")) & (F.col("ancestor") == F.col("_class"))).select("_file", F.col("name").alias("_heir"), "_name").distinct()
    return own.join(told, (F.col("file") == F.col("_file")) & (F.col("class_name") == F.col("_heir")) & (F.lower("name") == F.col("_name")), "left_semi")


def one_line_methods(rows: DataFrame, min_parameters: int = 1, min_callers: int = 2) -> DataFrame:
    """file, line, rule_id, symbol of methods whose body is one call.

    Exempt are those that an ancestor in the file declares, that are marked as overriding,
    that are called often enough in their file, whose names say what they are, and
    factories. Callers are counted by name.
    """
    body = rows.where(is_statement() & (F.col("unit.seq") == F.col("block.seq"))).groupBy("file", F.col("unit.seq").alias("seq")).agg(F.count("*").alias("n"), F.first("body").alias("only"), F.bool_or(F.col("kind").isNotNull()).alias("blocks"))
    callers = rows.where("unit is not null").select("file", F.explode(F.regexp_extract_all("body", F.lit(r"(?:->|::)\s*(\w+)\s*\("), F.lit(1))).alias("called")).groupBy(F.col("file").alias("_file"), F.col("called").alias("_name")).agg(F.count("*").alias("callers"))
    given = methods(rows).where("has_body").join(body, ["file", "seq"])
    parameters = F.size(F.regexp_extract_all(F.regexp_extract("head", rf"(?i)\bfunction\s+&?\s*\w+\s*({GROUP})", 1), F.lit(r"\$\w+"), F.lit(0)))
    one = given.where((F.col("n") == 1) & ~F.col("blocks") & F.col("only").rlike(r"^(?:return\s+)?[\s\S]*(?:(?:->|::)\s*\w+|(?<![\w$>:])\w+)\s*\(") & ~F.col("only").rlike(r"\bnew\s+(?:self|static|\w+)") & (parameters >= min_parameters))
    one = one.where(~F.col("name").rlike(SEMANTIC) & ~F.col("head").rlike(r"#?\[\s*\\?Override\b"))
    one = one.join(contract_methods(rows), ["file", "class_name", "name"], "left_anti").join(callers, (F.col("file") == F.col("_file")) & (F.col("name") == F.col("_name")), "left")
    return one.where(F.coalesce("callers", F.lit(0)) < min_callers).select("file", "line", F.lit("waste.one-line-method").alias("rule_id"), F.col("name").alias("symbol"))
