import random

import pytest

from data import awkward, frame, prose
from marketloom.llm import licenses


@pytest.fixture(scope="module")
def model(spark):
    r = random.Random(9)
    return licenses.fit(frame(spark, [(i, "\n".join(prose(r, 15) for _ in range(4))) for i in range(150)]))


def test_families_of_paragraphs(spark, model):
    r = random.Random(10)
    lines = {0: ("Released under the MIT License.", "MIT"), 1: ("Licensed under the Apache License, Version 2.0.", "Apache"),
             2: ("This work is licensed under the GNU General Public License, version 3.", "GPL"),
             3: ("Licensed under CC BY-NC 4.0.", "CC-BY-NC"), 4: ("Licensed under CC BY-SA 4.0.", "CC-BY-SA"),
             5: ("He holds a driving license since May.", None), 6: (prose(r, 20), None)}
    docs = frame(spark, [(i, f"{prose(r, 30)}\n{t}\n{prose(r, 30)}") for i, (t, _) in lines.items()])
    got = {x.doc_id: x for x in licenses.scan(docs, model).where("confirmed").collect()}
    assert {i: x.family for i, x in got.items()} == {i: f for i, (_, f) in lines.items() if f}
    assert all(x.paragraph == 1 and 0.5 <= x.probability <= 1 for x in got.values())


def test_awkward_rows(spark, model):
    rows = awkward(random.Random(1))
    assert licenses.scan(frame(spark, rows), model).collect() == []
    assert licenses.scan(frame(spark, rows[:0]), model).collect() == []
