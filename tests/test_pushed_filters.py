"""Filters on what follows from a class's path are asked of classes, never of every row of the given tables."""

import re

from kelpgraph import queries

SF = "/root/testdata/sf0.001"


def test_layers_are_no_filter_of_the_parts(spark):
    for name in ("layer_tree", "layer_contains", "plantuml_layer_tree"):
        plan = queries.Q[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        pushed = re.findall(r"DataFilters: \[([^\n]*?)\], Format", plan)
        assert pushed and not [p for p in pushed if "CASE" in p], name
