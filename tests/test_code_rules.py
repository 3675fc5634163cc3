"""Lexical code rules on small sources."""

from plumbline.rules import code

SOURCE = """<?php
use A\\Used;
use B\\Gone as Away;
// $x = 1; foo(); $y = 2;
/** Doc. */
class Thing extends Used
{
    private const DEAD = 1;
    /** p */
    private $live = "{ not a brace";
    public $open;
    private function hidden($strName, $q) { return md5($q . $this->live); }
    /** d */
    public function run($a, array $b = array(1, 2), $c = null) {
        if ($a && $b) { foreach ($b as $v) { if ($v) { while (1) { if ($c) { echo @file('x'); } } } } }
        try { exec("ls"); } catch (\\Exception $e) {}
        return Thing::class;
    }
    function nothing() {}
}
"""

TEST = """<?php
class FooTest {
    public function testOne() {
        sleep(1);
        if ($x) { $this->markTestSkipped(''); }
    }
    public function test_two() { $this->assertTrue(true); }
}
"""

EXPECTED = {
    (None, "waste.commented-out-code", None), (3, "waste.unused-import", "Away"), (6, "naming.class-file-mismatch", "Thing"), (8, "dead-code.unused-private-constant", "DEAD"), (8, "docs.missing-constant-phpdoc", "DEAD"),
    (11, "docs.missing-property-phpdoc", "open"), (11, "modernisation.public-property", "open"), (12, "dead-code.unused-private-method", "hidden"), (12, "docs.missing-public-phpdoc", "hidden"), (12, "naming.hungarian-notation", "strName"),
    (12, "naming.short-variable", "q"), (12, "security.weak-crypto", None), (14, "naming.generic-method", "run"), (14, "complexity.nesting-depth", "run"), (14, "naming.short-variable", "a"), (14, "naming.short-variable", "b"), (14, "naming.short-variable", "c"), (15, "naming.short-variable", "v"),
    (15, "security.error-suppression", None), (16, "security.dangerous-function-call", None), (16, "security.silent-catch", None), (19, "docs.missing-public-phpdoc", "nothing"), (19, "waste.empty-method", "nothing"),
}
EXPECTED_TEST = {
    (2, "docs.missing-class-phpdoc", "FooTest"), (2, "naming.test-naming-consistency", "FooTest"), (3, "docs.missing-public-phpdoc", "testOne"), (3, "test-quality.no-assertions", "testOne"),
    (4, "test-quality.sleep-in-test", "testOne"), (5, "test-quality.conditional-logic", "testOne"), (5, "test-quality.skipped-without-reason", "testOne"), (7, "docs.missing-public-phpdoc", "test_two"),
}


def test_rules(spark):
    units = spark.createDataFrame([("src/Other.php", "php", SOURCE), ("tests/FooTest.php", "php", TEST), ("e.php", "php", "")], "file string, type string, source string")
    found = code.code_findings(units).collect()
    assert {(r["line"], r["rule_id"], r["symbol"]) for r in found if r["file"] == "src/Other.php"} == EXPECTED
    assert {(r["line"], r["rule_id"], r["symbol"]) for r in found if r["file"] == "tests/FooTest.php"} == EXPECTED_TEST


def test_limits_and_masks(spark):
    body = "\n".join(f"    if ($a && '{{' == $b) {{ $c{i} = 1; }}" for i in range(60))
    source = "<?php\nfunction big(" + ", ".join(f"$p{i} = f(1, 2)" for i in range(11)) + ") {\n" + body + "\n    /* if */\n" + "\n".join(" " * i + "if (1) {" for i in range(6)) + "}" * 6 + "\n}\n"
    found = {r["rule_id"]: r["value"] for r in code.code_findings(spark.createDataFrame([("b.php", "php", source)], "file string, type string, source string")).collect()}
    assert found["complexity.cyclomatic"] == 1 + 120 + 6 and found["complexity.nesting-depth"] == 6 and found["size.parameter-count"] == 11
    assert "size.method-length" not in found


SCOPES = """<?php
class Thing extends Base {
    public function over($unused, bool $disableIt) { return 1; }
    private function own($left, $used) { return $used; }
    /**
     * Says what it does.
     *
     * @param string $used Its text.
     * @return string
     */
    #[Pure]
    public function told(string $used): string { return $used; }
    /** @return void */
    public function quiet(): void { curl_setopt($c, CURLOPT_SSL_VERIFYPEER, false); }
    public function calls() { return unserialize($this->x, ['allowed_classes' => false]) . unserialize('a'); }
}
"""


def test_scope_rules(spark):
    from plumbline.rules import scopes

    units = spark.createDataFrame([("src/Thing.php", "php", SCOPES), ("e.php", "php", ""), ("f.php", "php", "<?php\n/** alone")], "file string, type string, source string")
    found = {(r["line"], r["rule_id"], r["symbol"]) for r in scopes.scope_findings(units).collect()}
    assert found == {
        (3, "naming.negative-boolean", "disableIt"), (4, "waste.unused-parameter", "left"), (12, "docs.return-comment", "told"),
        (14, "docs.bare-phpdoc-tags", "quiet"), (14, "security.disabled-ssl-verification", None),
    }
