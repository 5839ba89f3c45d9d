import os
import threading

import pytest

from sparkloom.scratch import settled, written


def folder(df):
    return os.path.dirname(df.inputFiles()[0].removeprefix("file://"))


def test_settled_deletes_its_own_tables_only(spark):
    before = written(spark.range(3))
    inside = []

    def make():
        inside.append(folder(written(spark.range(4))))
        inner = settled(spark, lambda: written(spark.range(5)))
        inside.append(folder(inner))
        return inner.selectExpr("id + 1 AS id")

    out = settled(spark, make)
    assert sorted(r.id for r in out.collect()) == [1, 2, 3, 4, 5] and before.count() == 3
    assert not any(map(os.path.exists, inside))


def test_two_threads(spark):
    """Each one's tables are there until it has done, whatever the other deletes."""
    both, failed, found = threading.Barrier(2), [], {}

    def run(n):
        def make():
            mine = written(spark.range(n))
            both.wait(60)  # both have written
            if n == 7:
                both.wait(60)  # the other has settled
            return mine

        try:
            out = settled(spark, make)
            if n != 7:
                both.wait(60)
            found[n] = out.count()
        except Exception as e:  # noqa: BLE001
            failed.append(e)
            both.abort()

    threads = [threading.Thread(target=run, args=(n,)) for n in (7, 9)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not failed and found == {7: 7, 9: 9}


def test_a_failure_leaves_nothing(spark):
    inside = []

    def make():
        inside.append(folder(written(spark.range(2))))
        raise ValueError("no")

    with pytest.raises(ValueError):
        settled(spark, make)
    assert not os.path.exists(inside[0])
