"""Rules on names, signatures and comments: what each finds and what it leaves alone."""

import pytest

from plumbline.plans import catalogue, protocol
from plumbline.rules import conventions


@pytest.fixture
def found(spark):
    def run(sources, function):
        facts = protocol.Facts(spark.createDataFrame([(f, "php", s) for f, s in sources.items()], "file string, type string, source string"))
        needs = {"asserted_types": ("lines",), "file_comments": ("lines", "declarations")}.get(function, ("segments",))
        return sorted((r["file"], r["line"], r["symbol"], r["detector"]) for r in getattr(conventions, function)(*[facts[n] for n in needs]).collect())

    return run


def test_mixed_types(found):
    source = """<?php
function one(mixed $a, int $b, mixed ...$c): mixed { return $a; }
abstract class A {
  public function two(string $a = 'mixed $x, (', array $b = [1, 2],
    mixed &$c = null): int { return 1; }
  private function three(mixed $a): mixed { return $a; }
  abstract protected function four(mixed $a);
  abstract function five(private mixed $a);
  function six(?string $mixed, mixedType $a): mixedType { return function (mixed $b): mixed { return $b; }; }
}"""
    assert found({"a": source}, "mixed_types") == [("a", 2, "one", "$a, $c, return type"), ("a", 4, "two", "$c"), ("a", 8, "five", "$a")]


def test_header_pairs(found):
    send = lambda origin, more: f"header('Access-Control-Allow-Origin: {origin}'); {more}"
    allow = "\\Header(\"access-control-allow-credentials :TRUE\", true);"
    source = f"<?php\n{send('*', '')}\nfunction a() {{ {allow} }}\nfunction b() {{\n {allow}\n {send('*', '')}\n {send('*', '')} }}\nfunction c() {{ {send('https://x', allow)} }}\nfunction d() {{ {send('*', '$x->')}{allow[1:]} }}\nfunction e() {{ header($x . 'Access-Control-Allow-Origin: *'); {allow} }}\nfunction f() {{ {allow} $g = function () {{ {send('*', '')} }}; }}"
    assert found({"a": source, "b": f"<?php\n{allow}\n{send('*', '')}"}, "header_pairs") == [("a", 6, None, None), ("b", 3, None, None)]


def test_abbreviations(found):
    source = """<?php
$tmp = 1;
class A { private ?string $cfg = null; public static $db, $qq; protected int $Ab; const abc = 1;
  public function run($arg, $id, $value, $x) {
    $res = self::$zz; $ctx->usr = "$str"; $a = '$not'; $RES = 1; $this->foo = 1;
    foreach ($lst as $kk => $vv) { $kk = 2; }
    for ($ii = 0; $ii < $num; $ii++) { }
    try { } catch (\\E $err) { }
    $res = function ($fn) use ($ctx) { $arg = $fn; };
  }
  abstract function idle($abs);
}"""
    run = [(4, "arg"), (5, "ctx"), (5, "res"), (5, "str"), (6, "lst"), (7, "num")]
    assert found({"a": source}, "abbreviations") == sorted([("a", 3, "$cfg", "cfg"), ("a", 3, "$qq", "qq"), *[("a", line, "run", n) for line, n in run], ("a", 9, "closure@9", "fn"), ("a", 9, "closure@9", "arg"), ("a", 11, "idle", "abs")])


def test_file_comments(found):
    has = {
        "doc": "<?php\n/** Told. */\nuse A\\B;\nfunction f() { }", "declare": "<?php /** Told.\n */\ndeclare(strict_types=1);\nf();", "after-namespace": "<?php\nnamespace A;\n\n/** Told. */\n// more\nuse B;",
        "one-class": "<?php\nnamespace A;\nuse B;\n/** Told. */\n#[C]\nclass D { }", "braced": "<?php\nnamespace A {\nuse B;\n/** Told. */\nclass D { function g() { return new class { }; } }\n}", "same-line": "<?php\n/** Told. */ f();", "empty": "<?php\n", "blank": "",
    }
    lacks = {
        "none": "<?php\nf();", "plain": "<?php\n/* Told. */\nf();", "namespace": "<?php\n/** Told. */\nnamespace A;\nuse B;\nf();", "two": "<?php\nuse B;\n/** Told. */\nclass D { }\n/** Told. */\nclass E { }",
        "bare-class": "<?php\nclass D { /** Told. */ function f() { } }", "later": "<?php\nf();\n/** Told. */\ng();",
    }
    assert [r[0] for r in found(has | lacks, "file_comments")] == sorted(lacks)


def test_asserted_types(found):
    source = """<?php
/** @var A $one */
$one = f();
/** @var A $two because it is built above */
$two = f();
/**
 * @var A $three
 * @var B $four
 */
[$three, $four] = g();
/**
 * It is built above.
 * @var A $five
 */
$five = f();
class C {
  /** @var A $six */
  #[D]
  private static $six;
  /** @var int $seven */
  public function h(
    /** @var A $eight */
    A $eight,
  ) { /** @var A $nine */ $nine = 1; /* @var A $ten */ static $x; }
}
/** @var A */
$eleven = f();
/** @var A $last */"""
    assert found({"a": source}, "asserted_types") == [("a", 2, "$one", None), ("a", 6, "$four", None), ("a", 6, "$three", None), ("a", 24, "$nine", None), ("a", 28, "$last", None)]


def test_analyse_runs_them_by_selection(spark):
    units = spark.createDataFrame([("a.php", "php", "<?php\nfunction f(mixed $abc) { }"), ("b.md", "text", "function f(mixed $abc) { }"), ("c.php", "php", "")], "file string, type string, source string")
    rules = ("modernisation.mixed-type-overuse", "naming.abbreviation-allowlist", "docs.missing-file-phpdoc")
    rows = catalogue.analyse(units, catalogue.Selection(rules=rules)).collect()
    assert sorted((r["file"], r["line"], r["rule_id"], r["pillar"], r["severity"], r["confidence"]) for r in rows) == [
        ("a.php", 1, "docs.missing-file-phpdoc", "documentation", "advisory", "medium"), ("a.php", 2, "modernisation.mixed-type-overuse", "modernisation", "advisory", "medium"), ("a.php", 2, "naming.abbreviation-allowlist", "naming", "advisory", "high"),
    ]
