import os

import pytest

from fleetpulse.session import pinned, short_lived, unpinned


def stored(df):
    return os.path.isdir(df.stored_at)


def test_tables_go_with_their_block(spark):
    with short_lived(spark) as keep:
        first, second = pinned(spark.range(3)), keep(pinned(spark.range(4)))
        with short_lived(spark) as keep_inner:
            third, fourth = pinned(spark.range(5)), keep_inner(pinned(spark.range(6)))
        assert not stored(third) and stored(fourth) and stored(first)
        unpinned(first)
        assert not stored(first)
    assert stored(second) and second.count() == 4 and not stored(fourth)
    assert stored(pinned(spark.range(2)))


def test_a_failure_leaves_no_table(spark):
    with pytest.raises(RuntimeError), short_lived(spark):
        lost = pinned(spark.range(3))
        raise RuntimeError
    assert not stored(lost)
