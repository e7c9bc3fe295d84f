from __future__ import annotations

import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def texts() -> list[tuple[int | None, str | None]]:
    """Rows of doc_id and text: nulls, blanks, ties, copies, near copies, a very long text, odd white space."""
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(60), "  A Common Line that everybody has, in one form or another  "
    rows: list[tuple[int | None, str | None]] = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one two"), (5, "A\x85b\xa0c\x0bd"), (None, say(50)), (None, None)]
    rows += [(10 + i, f"{say(40)} {passage} {say(i)}") for i in range(4)]
    rows += [(20 + i, f"{say(20)}\n{line if i % 2 else line.strip().upper()}\n{say(5)}\n{line}") for i in range(7)]
    copy = say(120)
    rows += [(30 + i, copy) for i in range(5)] + [(30, copy), (31, "other text of a row with the same id " + say(40))]
    near = copy.split()
    for i in range(4):
        own = list(near)
        own[17 * (i + 1)] = "changed"
        rows.append((40 + i, "\n".join([" ".join(own[:60]), " ".join(own[60:])])))
    rows += [(50, "ha " * 300), (51, say(20_000)), (52, "x" * 50_000), (53, "word%%% " * 40 + say(80))]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """The rows with a clashing extra column in every operator's way."""
    rows = [(i, t, "en", f"s{n % 3}", len(t or ""), "x", 1) for n, (i, t) in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tkey string, rest int").repartition(5)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
