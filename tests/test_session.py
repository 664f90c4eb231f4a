import pytest

from inkloom import session


def hinted(df):
    return "hint" in df._jdf.queryExecution().logical().toString().lower()


def test_only_small_sides_are_broadcast(spark):
    df = spark.range(100).selectExpr("id", "repeat('x', 100) AS t")
    assert hinted(session.broadcast_if_small(df))
    assert not hinted(session.broadcast_if_small(df, rows=99))
    assert not hinted(session.broadcast_if_small(df, size=5_000))
    assert hinted(session.broadcast_if_small(df.limit(0))) and session.broadcast_if_small(df, rows=5).count() == 100


def test_a_cluster_must_name_its_shared_folder():
    class Unset:
        def get(self, *_):
            return ""

        def isDefined(self):
            return False

    class Session:
        conf = Unset()

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(Unset)

            class _jsc:
                class sc:
                    getCheckpointDir = staticmethod(Unset)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())
    Session.sparkContext.master = "local-cluster[3,2,1024]"
    with pytest.raises(RuntimeError):
        session.shared_folder(Session())
    Session.sparkContext.master = "local[2]"
    assert session.shared_folder(Session()).startswith("/")


def test_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").write_text("x")
    assert sorted(session.folder_names(spark, str(tmp_path))) == ["a", "b"]
    session.remove_folder(spark, str(tmp_path / "a"))
    assert session.folder_names(spark, str(tmp_path)) == ["b"]
