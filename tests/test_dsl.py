from datetime import datetime

import pytest
from hypothesis import given
from hypothesis import strategies as st

from trawl.model import EntryType, ParseError, SortField
from trawl.plans.dsl import normalise, parse, tokenize


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [("a b\tc", ["a", "b", "c"]), ('x"a b"y', ["x", "a b", "y"]), ('""', []), ("a\nb", ["a\nb"]), ('path:"a b"', ["path:", "a b"]), ('"path:a b"', ["path:a b"])],
)
def test_tokens(raw, tokens):
    assert tokenize(raw) == tokens


@pytest.mark.parametrize("raw", ['"a', "size:>=5", "size:x", "type:link", "modified:2024-13-01", "size:18446744073709551616", "modified:x", "modified:9999-12-31", "modified:0000-01-01"])
def test_errors(raw):
    with pytest.raises(ParseError):
        parse(raw)


def test_terms():
    q = parse("Main EXT:..RS path:/A type:Folder content:x size:>5 size:<9 modified:2024-01-02")
    assert q.keywords == ("main",) and q.search_content and q.sort_by is SortField.RELEVANCE
    f = q.filters
    assert (f.extension, f.path_contains, f.size_min, f.size_max, f.entry_type) == ("rs", "/A", 5, 9, EntryType.DIRECTORY)
    assert (f.modified_after, f.modified_before) == (datetime(2024, 1, 2), datetime(2024, 1, 3))
    assert parse("ext:a ext:b").filters.extension == "b"
    assert parse("文件名字").keywords == ("文件名字",)
    assert parse("  ").keywords == () and normalise(parse("")).limit == 500


@given(st.text(max_size=30))
def test_parse_never_breaks(raw):
    try:
        parse(raw)
    except ParseError:
        pass
