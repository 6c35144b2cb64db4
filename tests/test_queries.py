import math

import pytest

from chronoframe.engine import Engine
from chronoframe.errors import QueryError

NAN, INF = math.nan, math.inf


@pytest.fixture(scope="module")
def ask(make):
    def run(rows, text, start=0, end=100_000, match="first"):
        got = Engine(make(rows), match).query(text, start, end).collect()
        return sorted((r["name"], tuple(sorted(r["labels"].items())), r["ts"], r["value"]) for r in got)

    return run


def points(result):
    return [(t, v) for _, _, t, v in result]


def test_rate(ask):
    rows = [("http", {"method": "GET"}, 1000 * i, 10 * i) for i in range(60)]
    assert points(ask(rows, "rate(http[1m])", 0, 60_000)) == [(59_000, 10.0)]


def test_rate_resets_and_short_series(ask):
    assert points(ask([("c", {}, t, v) for t, v in ((0, 10), (1000, 15), (2000, 3), (3000, 5))], "rate(c)")) == [(3000, 10 / 3)]
    assert ask([("c", {}, 0, 1)], "rate(c)") == []
    assert ask([("c", {}, 5, 1), ("c", {}, 5, 2)], "rate(c)") == []
    assert math.isnan(points(ask([("c", {}, 0, 1), ("c", {}, 1000, NAN), ("c", {}, 2000, 2)], "rate(c)"))[0][1])


def test_aggregates(ask):
    rows = [("cpu", {"host": "a"}, 5000 * i, 40 + i) for i in range(3)] + [("cpu", {"host": "b"}, 5000 * i, 60 + i) for i in range(3)]
    assert points(ask(rows, "sum(cpu)")) == [(0, 100), (5000, 102), (10_000, 104)]
    assert points(ask(rows, "avg(cpu)"))[0] == (0, 50)
    assert points(ask(rows, "count(cpu)"))[0] == (0, 2.0)
    assert points(ask(rows, "max(cpu)"))[0] == (0, 60) and points(ask(rows, "min(cpu)"))[0] == (0, 40)
    assert ask(rows, "sum(none)") == []


def test_by(ask):
    rows = [("h", {"method": m, "host": h}, 1000, v) for m, h, v in (("GET", "a", 100), ("GET", "b", 200), ("POST", "a", 50), ("POST", "b", 75))]
    assert ask(rows, "sum(h) by (method)") == [("", (("method", "GET"),), 1000, 300), ("", (("method", "POST"),), 1000, 125)]
    assert ask(rows, "sum by (__name__) (h)") == [("", (("__name__", "h"),), 1000, 425)]
    assert ask(rows, "sum(h) by (none)") == [("", (), 1000, 425)]
    assert ask(rows, "sum(h) without (host)") == ask(rows, "sum(h) by (method)")
    assert [v for *_, v in ask(rows, "topk(1, h) by (method)")] == [200, 75]
    assert points(ask(rows, "bottomk(1, h)")) == [(1000, 50)]


def test_nan_and_duplicates(ask):
    rows = [("m", {"s": "1"}, 1, NAN), ("m", {"s": "2"}, 1, 2.0)]
    assert points(ask(rows, "max(m)")) == [(1, 2)] and points(ask(rows, "min(m)")) == [(1, 2)]
    assert math.isnan(points(ask(rows, "sum(m)"))[0][1])
    assert points(ask(rows[:1], "max(m)")) == [(1, -INF)] and points(ask(rows[:1], "min(m)")) == [(1, INF)]
    assert points(ask([("m", {}, 1, 1), ("m", {}, 1, 9)], "sum(m)")) == [(1, 1)]


def test_quantile(ask):
    rows = [("m", {}, t, v) for t, v in enumerate((5, 1, 4, 2, 3), 1)]
    for q, v in ((0.5, 3), (0, 1), (1, 5)):
        assert points(ask(rows, f"histogram_quantile({q}, m)")) == [(5, v)]
    assert ask(rows, "histogram_quantile(1.5, m)") == []
    assert math.isnan(points(ask([("m", {}, 1, 1), ("m", {}, 2, NAN)], "histogram_quantile(0, m)"))[0][1])


def test_arithmetic(ask):
    two = [("m", {"k": "v"}, 1, 4), ("m", {"k": "v"}, 2, 4)]
    labels = (("__name__", "m"), ("k", "v"))
    assert ask(two, "m * 100 + 1") == [("m", labels, 1, 401), ("m", labels, 2, 401)]
    assert points(ask(two, "m / 0")) == [(1, 0), (2, 0)]
    assert ask(two, "10 - m") == [("m", labels, 1, 6), ("m", labels, 2, 6)]
    assert ask(two[:1], "10 - m", 0, 77) == [("", (), 77, 6)]
    assert ask([], "2 * 3 + 1", 0, 5) == [("", (), 5, 7)]
    other = [("b", {}, 1, 1), ("b", {}, 2, 1)]
    assert points(ask(two + other, "m + b")) == [(1, 4), (2, 4)]
    assert points(ask(two, "m + none")) == [(1, 4), (2, 4)]
    assert ask(two, "none + m") == []
    assert points(ask(two + other[:1], "m - b")) == [(1, 3), (2, 3)]
    assert points(ask(two + other[:1], "b - m")) == [(1, -3), (2, -3)]
    assert ask(other[:1], "none + b") == []
    assert ask(other[:1], "b + none") == []


def test_label_matching_extension(ask):
    rows = [("a", {"h": "1"}, 1, 5), ("a", {"h": "2"}, 1, 6), ("b", {"h": "1"}, 1, 2), ("b", {"h": "1"}, 2, 2)]
    assert points(ask(rows, "a - b", match="labels")) == [(1, 3)]


def test_ranges(ask):
    rows = [("m", {}, t * 60_000, 1) for t in (-9, -4, 0)]
    assert len(ask(rows, "m[5m]", 0, 1)) == 3 and len(ask(rows, "m", 0, 1)) == 1
    assert len(ask(rows, "m", -240_000, 0)) == 2


def test_matchers(ask):
    rows = [("m", {"k": k}, 1, 1) for k in ("ab", "ab\n", "z")] + [("m", {}, 1, 1)]
    found = lambda q: len(ask(rows, q))
    assert found('m{k=~"ab"}') == 1 and found('m{k!="z"}') == 2 and found('m{k!~"a.*"}') == 2
    assert found('m{k=""}') == 0 and found('m{__name__="m"}') == 4 and found('m{x!="1"}') == 0
    for bad in ("(", "a(?=b)", r"(a)\\1"):
        with pytest.raises(QueryError):
            ask(rows, f'm{{k=~"{bad}"}}')


@pytest.mark.parametrize(
    "pattern, yes, no",
    [
        ("[[:alpha:]]+", ["zzz"], ["::", "a1"]), ("[^[:alpha:]]", ["1"], ["a"]), (r"[[:^digit:]]", ["a"], ["1"]), (r"\pL+", ["aé"], ["a1"]), (r"\p{Greek}+", ["αβ"], ["ab"]), (r"\PN", ["x"], ["5"]),
        (r"\Qa.b\E", ["a.b"], ["axb"]), (r"\Qa.b\E+", ["a.bb"], ["a.ba.b"]), (r"[a-z&&[^z]]+", ["a]", "&]", "[]"], ["a", "z"]), (r"\s", [" "], ["\x0b"]), (r"[\s]", ["\t"], ["\x0b"]), (r"\v", ["\x0b"], ["\n"]),
        ("ab$", ["ab"], ["ab\n"]), ("(?m)a$\\nb", ["a\nb"], ["ab"]), ("a{,2}", ["a{,2}"], ["aa"]), ("(?P<x>a)|(?<y_1>b)", ["a", "b"], ["c"]), (r"\x{1F600}", ["😀"], ["x"]), (r"\101", ["A"], ["1"]), ("(?i)AB", ["ab"], ["b"]), ("a.b", ["a\rb"], ["a\nb"]), ("]", ["]"], ["a"]), ("a{1,2}?", ["aa"], ["aaa"]),
    ],
)
def test_re2_patterns(spark, pattern, yes, no):
    from chronoframe.operators.matchers import whole_match

    rows = spark.createDataFrame([(x,) for x in yes + no], "x string")
    got = {r["x"] for r in rows.filter(rows["x"].rlike(whole_match(pattern))).collect()}
    assert got == set(yes)


@pytest.mark.parametrize("pattern", ["a++", "a**", "(?=a)", "(?<!a)b", r"(a)\1", "(?>a)", "a{1001}", "a{2,1}", "(", ")", "[a", "[[:nope:]]", "*a", r"\k<x>", r"\C", r"\Z", "(?U)a", r"\p{Nope}"])
def test_patterns_that_re2_lacks(spark, pattern):
    from chronoframe.operators.matchers import whole_match

    with pytest.raises(QueryError):
        whole_match(pattern)


def test_rate_over_many_parts(ask):
    """Samples of several days, with resets within and between them, equal ones and a day without any."""
    import random

    rng, day = random.Random(2), 86_400_000
    rows = [("c", {"h": h}, d * day + 1000 * i, rng.randint(0, 9)) for h in "ab" for d in (0, 1, 3) for i in range(4)]
    got = {dict(r[1])["h"]: r[3] for r in ask(rows, "rate(c)", 0, 9 * day)}
    for h in "ab":
        v = [r[3] for r in rows if r[1]["h"] == h]
        gain = sum(b - a if b >= a else b for a, b in zip(v, v[1:], strict=False))
        assert got[h] == pytest.approx(gain / ((3 * day + 3000) / 1000))
