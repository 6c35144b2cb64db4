import pytest

from chronoframe.errors import QueryError
from chronoframe.functions.durations import config_duration
from chronoframe.plans.nodes import Aggregate, Binary, Call, Matcher, Number, Selector
from chronoframe.plans.parser import parse, parse_duration


@pytest.mark.parametrize(
    "text",
    ['rate(http_requests_total{method="GET"}[5m])', "sum(rate(http_requests_total[5m])) by (method)", 'avg(cpu_usage{host=~"web-.*"}) by (host)', "max(memory_bytes)", "min(cpu_usage)", "count(up)", "cpu_usage * 100", "memory_used / memory_total * 100", "avg by (host)(cpu_usage_percent)", "a{}", "sum", "rate", "rate[5m]", "sum(a) by ()", "m{l=\"x\\\"y\"}"],
)
def test_accepts(text):
    parse(text)


@pytest.mark.parametrize("text", ["{", "cpu{host=}", "rate(", "sum() by", '"unterminated', "!invalid", "-5", "a{b=\"c\",}", "sum(a, b)", "rate(a, b)", "histogram_quantile(a, b)", "a[5m][5m]", "a[1h30m]", "a b", "1.2.3", ".", "by", "sum[5m]", "5m", "a{by=\"x\"} by", "topk(a, b)", ""])
def test_rejects(text):
    with pytest.raises(QueryError):
        parse(text)


def test_trees():
    assert parse('sum by (a) (rate(m{l!~"x"}[2h]))') == Aggregate("sum", Call("rate", (Selector("m", (Matcher("l", "!~", "x"),), 7_200_000),)), by=("a",))
    assert parse("1 + 2 * a - 3") == Binary("-", Binary("+", Number(1), Binary("*", Number(2), Selector("a"))), Number(3))
    assert parse("(1 + 2) * a") == Binary("*", Binary("+", Number(1), Number(2)), Selector("a"))
    assert parse(r'm{a="x\n\\"}').matchers[0].value == "xn\\"
    assert parse("topk(3, m) by (a)") == Aggregate("topk", Selector("m"), by=("a",), k=3)


def test_durations():
    assert [parse_duration(x) for x in ("5s", "5m", "1h", "7d")] == [5000, 300_000, 3_600_000, 604_800_000]
    good = {"500ms": 500, "30s": 30_000, "15m": 900_000, "2h": 7_200_000, "1d": 86_400_000, "1w": 604_800_000, "1d12h": 129_600_000, "1w1d": 691_200_000, "2h30m": 9_000_000}
    assert {k: config_duration(k) for k in good} == good
    for bad in ("", "abc", "10", "d", "-", "1.5d"):
        with pytest.raises(ValueError):
            config_duration(bad)


def test_error_has_a_position():
    with pytest.raises(QueryError) as e:
        parse("a + }")
    assert e.value.position == 4
