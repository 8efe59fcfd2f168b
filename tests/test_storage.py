import os

import pytest

from interlace.plans.storage import Written, fits, shared_dir, written


def test_written_and_dropped(spark):
    with Written(spark) as outer:
        t = written(spark.range(5).selectExpr("id", "cast(id as string) as s"), "t")
        with Written(spark) as inner:
            u = written(spark.range(3), "u")
    v = written(spark.range(2), "v")
    assert t.count() == 5 and fits(t, "length(s)") and not fits(t, "length(s)", 50) and fits(t.limit(0), "length(s)")
    folders = [p.removeprefix("file:") for p in outer.paths + inner.paths]
    assert all(map(os.path.exists, folders)) and inner.drop() == 1 and not os.path.exists(folders[1])
    assert t.count() == 5 and v.count() == 2 and outer.drop() == 1 and outer.drop() == 0 and not os.path.exists(folders[0])
    with pytest.raises(Exception):
        u.count()


def test_other_masters_need_a_shared_folder():
    class Context:
        master = "local-cluster[2,1,1024]"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        shared_dir(Session())
