import importlib
import sys

import pytest

import __spark_entry__
from vellumdex.session import shared_folder, written


class Context:
    def __init__(self, master, checkpoint=None):
        self.master, self.checkpoint = master, checkpoint

    def getCheckpointDir(self):  # noqa: N802
        return self.checkpoint


class Session:
    def __init__(self, master, checkpoint=None, **conf):
        self.sparkContext, self.conf = Context(master, checkpoint), conf


def test_shared_folder_is_named_by_the_session():
    assert shared_folder(Session("spark://x", **{"spark.checkpoint.dir": "hdfs:///c/"})) == "hdfs:///c"
    assert shared_folder(Session("spark://x", "hdfs:///d")) == "hdfs:///d"
    with pytest.raises(ValueError):
        shared_folder(Session("spark://x"))
    local = Session("local[2]")
    assert shared_folder(local).startswith("file:///") and shared_folder(local) == shared_folder(local)


def test_written_is_the_same_table(spark):
    df = spark.createDataFrame([(1, None, [1.5]), (2, "b", [])], "a int, b string, c array<double>")
    again = written(df, "t")
    assert again.schema == df.schema and sorted(again.collect()) == sorted(df.collect())
    assert written(df.limit(0), "t").collect() == []


def test_other_queries_work_without_the_subpackage(monkeypatch):
    whole = importlib.import_module

    def missing(name):
        if name.startswith("vellumdex.llm"):
            raise ImportError("No module named 'regex'")
        return whole(name)

    monkeypatch.setattr(importlib, "import_module", missing)
    names = set(__spark_entry__.queries())
    assert "bm25_or_top10" in names and "p1_found" in names and not any(n.startswith("p2") for n in names)
    assert "vellumdex" in sys.modules
