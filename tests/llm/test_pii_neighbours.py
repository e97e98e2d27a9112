"""Digits next to a value do not hide it."""

import pytest

from lithic.llm import pii

CARD, GROUPED, SPACED = "4785380592391139", "4785-3805-9239-1139", "4785 3805 9239 1139"
ROWS = [
    (f"card {CARD} 123", [CARD]), (f"id 12 {GROUPED}", [GROUPED]), ("Invoice 10023 2020-02-29", ["2020-02-29"]), ("ref 12345 555-123-4567", ["555-123-4567"]),
    (f"1111 {SPACED}", [SPACED]), (f"{SPACED} 1111", [SPACED]), (f"{SPACED} 123", [SPACED]), (f"{SPACED} {SPACED}", [SPACED]), (f"{SPACED} 2020-02-29", [SPACED, "2020-02-29"]),
    (f"{SPACED} 555-123-4567", [SPACED, "555-123-4567"]), ("3782 822463 10005 x", ["3782 822463 10005"]), ("4785380 592391139", ["4785380 592391139"]), ("47 85-38 05 92391139 y", ["47 85-38 05 92391139"]),
]


@pytest.fixture(scope="module")
def changed(spark):
    df = spark.createDataFrame([(t,) for t, _ in ROWS], "text string")
    return [(r.text, r.n) for r in pii.pseudonymize(df, "key", count="n").collect()]


@pytest.fixture(scope="module")
def alone(spark):
    values = sorted({v for _, vs in ROWS for v in vs})
    return dict(zip(values, (r.text for r in pii.pseudonymize(spark.createDataFrame([(v,) for v in values], "text string"), "key").collect())))


@pytest.mark.parametrize("k", range(len(ROWS)))
def test_neighbours_do_not_hide(changed, alone, k):
    text, values = ROWS[k]
    want = text
    for v in values:
        assert alone[v] != v
        want = want.replace(v, alone[v])
    assert changed[k][0] == want and changed[k][1] >= 1
