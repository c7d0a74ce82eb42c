"""Switches between collections: races, crashes, roll back and clean-up."""

import pytest

from corpusloom.sources.shadow import Pointer, Shadow


@pytest.fixture
def pair(spark, tmp_path):
    now = [4e9]
    return Shadow(spark, f"file://{tmp_path}", lambda: now[0]), now


def rows(spark, n, name="x"):
    return spark.range(n).withColumnRenamed("id", name)


def test_switch_and_roll_back(spark, pair):
    s, _ = pair
    assert s.current() is None and not s.roll_back()
    a, b = s.create(rows(spark, 10)), s.create(rows(spark, 20))
    assert s.validate(a)[0] and s.switch(a) and s.current() == a and s.read().count() == 10
    assert s.validate(b)[0] and s.switch(b) and (s.current(), s.previous()) == (b, a) and s.read().count() == 20
    assert s.roll_back() and (s.current(), s.previous()) == (a, b) and s.roll_back() and s.current() == b
    for bad, why in ((rows(spark, 0), "empty"), (rows(spark, 30, "y"), "lacks"), (rows(spark, 17), "17 rows")):
        ok, told = s.validate(s.create(bad))
        assert not ok and why in told


def test_of_two_switches_one_wins(spark, pair, tmp_path):
    s, _ = pair
    a, b, c = (s.create(rows(spark, n)) for n in (1, 2, 3))
    s.switch(a)
    seen, _ = s.pointer.read()
    assert s.pointer.write({"current": b, "previous": a, "at": 0}, seen)
    assert not s.pointer.write({"current": c, "previous": a, "at": 0}, seen) and s.current() == b
    # both have looked and take the same number
    one, two = Pointer(spark, s.pointer.path), Pointer(spark, s.pointer.path)
    assert one._create(f"{one.path}/000000000099", '{"current": "c1"}') and not two._create(f"{two.path}/000000000099", '{"current": "c2"}')
    assert s.pointer.read() == (99, {"current": "c1"})


@pytest.mark.parametrize("left", ["", '{"current": "c'])
def test_a_writer_that_dies_loses_nothing(spark, pair, tmp_path, left):
    s, _ = pair
    a, b = s.create(rows(spark, 1)), s.create(rows(spark, 2))
    s.switch(a)
    (tmp_path / "pointer" / "000000000002").write_text(left)
    assert s.current() == a and s.switch(b) and (s.current(), s.previous()) == (b, a)
    assert [n for n, _ in s.pointer.history()] == [1, 3]


def test_clean_up(spark, pair):
    s, now = pair
    names = [s.create(rows(spark, n)) for n in range(1, 5)]
    for n in names[:3]:
        s.switch(n)
    assert s.clean_up(delay=300) == sorted([names[3]])  # never live, long since made
    lease = s.hold(names[0], 1000)
    now[0] += 400
    assert s.clean_up(delay=300) == []
    s.release(lease)
    assert s.clean_up(delay=300) == [names[0]] and s.read().count() == 3
    assert s.roll_back() and s.read().count() == 2
    s.hold(names[2], 10)
    now[0] += 20
    assert s.clean_up(delay=0) == []
