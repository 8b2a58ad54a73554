import pytest

from lectern import session


class Context:
    applicationId = "app-1"

    def __init__(self, master):
        self.master = master


class Conf:
    def __init__(self, folder):
        self.folder = folder

    def get(self, name, default):
        assert name == "spark.checkpoint.dir"
        return self.folder or default


class Session:
    def __init__(self, master, folder=None):
        self.sparkContext, self.conf = Context(master), Conf(folder)


def test_the_named_folder_is_used():
    assert session.shared_folder(Session("yarn", "hdfs://shared/x")) == "hdfs://shared/x"
    assert session.fresh_path(Session("yarn", "s3://b/x/"), "a").startswith("s3://b/x/a-")


def test_a_cluster_must_name_a_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(Session("yarn"))


def test_a_local_session_gets_one_of_its_own():
    first = session.shared_folder(Session("local[2]"))
    assert first == session.shared_folder(Session("local[2]"))


def test_written_rows_come_back(spark):
    df = spark.range(5).selectExpr("id", "array(struct(id AS a)) AS s")
    back = session.materialise(df)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert "RDD" not in back._jdf.queryExecution().executedPlan().toString()


def test_scratch_leaves_only_what_is_kept(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    left = lambda: sorted(p.name.split("-")[0] for p in tmp_path.iterdir())
    before = session.materialise(spark.range(1), "before")
    with session.scratch(spark) as kept:
        a = session.materialise(spark.range(3), "a")
        with session.scratch(spark) as inner:
            b = inner(a.union(session.materialise(spark.range(2), "c")), "b")
        assert left() == ["a", "b", "before"]
        result = kept(b.distinct())
    assert left() == ["before", "result"] and result.count() == 3 and before.count() == 1
    with pytest.raises(ZeroDivisionError):
        with session.scratch(spark):
            session.materialise(spark.range(3), "a")
            1 / 0
    assert left() == ["before", "result"]
