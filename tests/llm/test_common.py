"""The shared folder: none on a cluster is an error, and operators leave only their results' tables."""

import os
from types import SimpleNamespace
from urllib.parse import urlparse

import pytest

from phonolith.llm import common, simhash


def test_a_cluster_without_a_shared_folder_is_an_error():
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,512]"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(session)


def test_reserved_columns_are_refused(spark):
    with pytest.raises(ValueError, match="reserved"):
        common.checked(spark.range(1).withColumnRenamed("id", common.mark("id").upper()))


def test_near_duplicates_leave_two_tables(spark):
    base = f"{urlparse(common.shared_dir(spark)).path}/phonolith"
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    docs = spark.createDataFrame([(i, f"some words of the text number {i // 2}") for i in range(40)], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 40
    assert len(set(os.listdir(base)) - before) == 2
