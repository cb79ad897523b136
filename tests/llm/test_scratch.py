"""The folder of intermediate tables."""

from types import SimpleNamespace

import pytest

from lendlens.llm.scratch import folder


def session(master, shared=None, checkpoints=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: checkpoints)
    conf = SimpleNamespace(get=lambda key, default: shared or default)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_folder_or_an_error():
    assert folder(session("spark://host:7077", shared="s3://b/x/")).startswith("s3://b/x/llm-")
    assert folder(session("spark://host:7077", checkpoints="/shared")).startswith("/shared/llm-")
    assert folder(session("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        folder(session("spark://host:7077"))
