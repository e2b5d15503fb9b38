"""Tables that cut lineage: where they stand and when they go."""

from __future__ import annotations

import os
from types import SimpleNamespace

import pytest

from codestrata import session


def test_cut_and_drop(spark):
    df = session.cut(spark.range(5))
    folder = session.cut_folder(spark).removeprefix("file://")
    assert df.count() == 5 and os.listdir(folder)
    session.drop_cuts(spark)
    assert not os.path.exists(folder)
    assert session.cut(spark.range(3)).count() == 3


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda name, default=None: default)
    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        session.shared_folder(SimpleNamespace(conf=conf, sparkContext=context))
