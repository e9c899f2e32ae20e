"""The five-level sample table: domains, rules and defaults."""

from stepwell.operators.filters import PairRule
from stepwell.sources.generate import labels_up_to

# The levels, their domains and the default selection.
LEVELS = ["colA", "colB", "colC", "colD", "colE"]
DOMAINS = {
    "colA": labels_up_to("A", 5),
    "colB": labels_up_to("B", 5),
    "colC": labels_up_to("C", 5),
    "colD": labels_up_to("D", 5),
    "colE": labels_up_to("E", 5),
}
DEFAULTS = {"colA": "A1", "colB": "B2", "colC": "C3", "colD": "D4", "colE": "E5"}

# The rules the sample table is built with. The fourth one tests
# colD for a value colD never has, so it drops nothing.
RULES = [
    PairRule("colA", "A1", "colB", "B1"),
    PairRule("colA", "A2", "colC", "C2"),
    PairRule("colA", "A3", "colD", "D3"),
    PairRule("colA", "A4", "colD", "E4"),
    PairRule("colB", "B1", "colC", "C1"),
    PairRule("colB", "B2", "colD", "D2"),
    PairRule("colB", "B3", "colE", "E3"),
    PairRule("colC", "C1", "colD", "D1"),
    PairRule("colC", "C2", "colE", "E2"),
    PairRule("colD", "D1", "colE", "E1"),
]

# What is said about the sample table. The fourth statement does
# not hold for a table built with RULES.
STATEMENTS = [
    PairRule("colA", "A1", "colB", "B1"),
    PairRule("colA", "A2", "colC", "C2"),
    PairRule("colA", "A3", "colD", "D3"),
    PairRule("colA", "A4", "colE", "E4"),
    PairRule("colB", "B1", "colC", "C1"),
    PairRule("colB", "B2", "colD", "D2"),
    PairRule("colB", "B3", "colE", "E3"),
    PairRule("colC", "C1", "colD", "D1"),
    PairRule("colC", "C2", "colE", "E2"),
    PairRule("colD", "D1", "colE", "E1"),
]

# Level to the level whose value is tested in its place, for the
# behaviour in which the last two levels test the second level's value.
TEST_FROM = {"colD": "colB", "colE": "colB"}

# Short names of the levels in the order of events.
LABELS = {"colB": "B", "colC": "C", "colD": "D", "colE": "E"}
