import pytest

from quillion.sources.fragments import FragmentParseError, build_source_fragment, parse_source_fragment


@pytest.mark.parametrize(
    "source, parts",
    [
        ("data.csv", ("data.csv", None, None)),
        ("p.html#html", ("p.html", "html", None)),
        ("p.html#html:1", ("p.html", "html", 1)),
        ("R.md#markdown:-1", ("R.md", "markdown", -1)),
        ("data#:2", ("data", None, 2)),
        ("d.json#json:a.b[0].c", ("d.json", "json", "a.b[0].c")),
        ("https://x.org/a#b#csv:0", ("https://x.org/a#b", "csv", 0)),
        ("data.csv#", ("data.csv", None, None)),
    ],
)
def test_parse(source, parts):
    assert parse_source_fragment(source) == parts


@pytest.mark.parametrize("source", ["a#xls", "a#html:", "a#xls:1"])
def test_bad(source):
    with pytest.raises(FragmentParseError):
        parse_source_fragment(source)


@pytest.mark.parametrize("args", [("a.html", "html", 1), ("a.csv", "csv", None), ("a.html", None, 2), ("a", None, None)])
def test_round_trip(args):
    assert parse_source_fragment(build_source_fragment(*args)) == args
