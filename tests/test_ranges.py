import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerloom.errors import LoomError
from ledgerloom.plans import ranges
from ledgerloom.plans.ranges import Range

some = st.tuples(st.integers(0, 40), st.one_of(st.none(), st.integers(0, 40))).map(lambda t: Range(t[0], None if t[1] is None else t[0] + t[1]))


def blocks(r, top=120):
    return set() if r is None else set(range(r.low, (top if r.high is None else r.high) + 1))


@given(some, some)
def test_algebra(a, b):
    assert blocks(ranges.intersection(a, b)) == blocks(a) & blocks(b)
    assert set().union(*map(blocks, ranges.difference(a, b))) == blocks(a) - blocks(b)


@given(st.lists(some, max_size=6))
def test_merge_is_disjoint_and_complete(given_ranges):
    merged = ranges.merge([(r, i) for i, r in enumerate(given_ranges)])
    for n in range(120):
        held = [x for r, x in merged if n in blocks(r)]
        assert len(held) <= 1
        assert sorted(held[0] if held else []) == [i for i, r in enumerate(given_ranges) if n in blocks(r)]
    assert all(a.high < b.low for (a, _), (b, _) in zip(merged, merged[1:], strict=False))


def test_overlap_gives_three_segments():
    assert ranges.merge([(Range(0, 100), "a"), (Range(50, 150), "b")]) == [(Range(0, 49), ["a"]), (Range(50, 100), ["a", "b"]), (Range(101, 150), ["b"])]


def test_touching_ranges_stay_apart():
    assert [r for r, _ in ranges.merge([(Range(0, 100), "a"), (Range(101, 200), "b")])] == [Range(0, 100), Range(101, 200)]


def test_inverted_range_is_refused():
    with pytest.raises(LoomError, match="E0002"):
        Range(5, 4)


def test_next_queried_and_bound():
    assert ranges.next_queried([Range(0, 10), Range(20, 30)], 11) == 20
    assert ranges.next_queried([Range(0, 10)], 11) is None
    assert ranges.bound([Range(0, 10), Range(20)], Range(5, 25)) == [Range(5, 10), Range(20, 25)]
    assert ranges.bound([], Range(7)) == [Range(7)]


def parse(low, high=None, resume=None):
    return ranges.parse(low, high, lambda: 900, lambda s: None if s > 2_000_000_000 else s // 1000, resume)


def test_parsing():
    assert parse("1,000", "2_000") == Range(1000, 2000)
    assert parse("1000", "+500") == Range(1000, 1500)
    assert parse("1970-01-02", "+500") == Range(86, 500)
    assert parse("1970-01-02T00:00:30Z") == Range(86)
    assert parse(None, 0) == Range(0)
    assert parse("latest") == Range(900)
    assert parse("latest", resume=500) == Range(500)
    for low, high in (("latest", "2024-01-01"), ("2090-01-01", None), ("x", None)):
        with pytest.raises(LoomError, match="E0002"):
            parse(low, high)
