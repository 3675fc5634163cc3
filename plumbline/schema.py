"""Schemas of the tables that the operators exchange.

A *unit* is one text to analyse; a *finding* is one row per reported problem.
``ord`` is the position in which a finding was produced and breaks all ties.
"""

UNIT = "file string, type string, source string"
FINDING = (
    "ord long, rule_id string, file string, line int, end_line int, column int, symbol string, message string, "
    "severity string, pillar string, confidence string, m_complexity int, m_lines int, preview string"
)
SEVERITIES = ("advisory", "warning", "error")
STATIC_PILLARS = ("size", "complexity", "maintainability", "dead-code", "naming", "documentation", "modernisation", "security", "sensitive-data", "test-quality")
