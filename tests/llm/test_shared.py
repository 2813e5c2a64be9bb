"""Where intermediate tables go, and that they go away."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from factloom.llm import exact, shared, warc
from tests.llm.helpers import documents


class Conf(dict):
    """A session's settings; core settings cannot be changed, as in Spark."""

    def set(self, key, value):
        assert key != "spark.checkpoint.dir"
        self[key] = value


def session(master="local[2]", **settings):
    return SimpleNamespace(conf=Conf(settings), sparkContext=SimpleNamespace(master=master))


def test_the_folder_that_the_cluster_names():
    assert shared.shared_root(session("spark://x", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert shared.shared_root(session("yarn", **{shared.OWN_FOLDER: "/mnt/x"})) == "/mnt/x"


def test_a_local_session_gets_one_folder():
    local = session()
    root = shared.shared_root(local)
    assert root.startswith("file:///") and shared.shared_root(local) == root


def test_elsewhere_no_folder_is_made_up():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_root(session("spark://host:7077"))


@pytest.fixture
def no_folder(spark, monkeypatch):
    """The session as it is where nothing names a folder."""
    plain = type(spark.conf).get
    monkeypatch.setattr(
        type(spark.conf), "get", lambda self, key, *rest: None if key == "spark.checkpoint.dir" else plain(self, key, *rest)
    )
    return spark


def test_operators_run_without_a_checkpoint_setting(no_folder):
    docs = documents(no_folder, [(1, "a"), (2, "a"), (3, "b")])
    assert exact.kept_rows(docs).count() == 2
    pages = no_folder.createDataFrame([(1, "u", "<p>"), (2, "v", "<p>")], "page_id long, url string, html string")
    path = warc.archive(warc.page_records(pages))
    assert warc.read_archive(no_folder, path).count() == 2


def test_written_tables_and_their_shuffles_go(spark):
    rows = shared.written(spark.range(100).groupBy("id").count(), "some")
    (folder,) = {f.rsplit("/", 1)[0].removeprefix("file:") for f in rows.inputFiles()}
    folder = "/" + folder.lstrip("/")
    assert rows.count() == 100 and os.path.isdir(folder)
    shared.forget(rows)
    assert not os.path.exists(folder)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
