"""COVERAGE.md names, for every item, exactly the queries whose registration claims it."""

import os
import re

from arcweave.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_items_are_those_of_the_registry():
    by: dict[str, list[str]] = {}
    for name, ids in registry.operators().items():
        for i in ids.split():
            by.setdefault(i, []).append(name)
    with open(os.path.join(ROOT, "COVERAGE.md")) as f:
        said = dict(re.findall(r"^\| ([A-Z]+-\d+) \| ([^|]*?) \|", f.read(), re.M))
    assert set(by) <= set(said)
    assert {i: q for i, q in said.items() if q != "left out"} == {i: ", ".join(sorted(q)) for i, q in by.items()}
