import os
import pathlib
import re
from types import SimpleNamespace

import pytest

from presswork.llm import shared


def session(master, folder=""):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder or default),
                           sparkContext=SimpleNamespace(master=master, applicationId=f"app {master}"))


def test_scratch_folder_is_the_sessions():
    assert shared.scratch(session("spark://host", "hdfs://name/shared/")) == "hdfs://name/shared"


@pytest.mark.parametrize("master", ["local", "local[4]"])
def test_one_machine_gets_one_folder_of_its_own(master):
    assert shared.scratch(session(master)) == shared.scratch(session(master))


@pytest.mark.parametrize("master", ["spark://host", "local-cluster[2,1,1000]", "yarn"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.scratch(session(master))


def test_stored_rows_come_back_and_can_be_discarded(spark):
    df = shared.stored(spark.range(10), "test")
    assert df.count() == 10 and df.dtypes == spark.range(10).dtypes
    shared.discard(spark.range(3))
    files = df.inputFiles()
    shared.discard(df)
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)


def test_a_worker_keeps_the_states_it_used_last():
    made = []

    def use(name):
        return shared.per_process(name, lambda: made.append(name) or name)

    assert [use(n) for n in "aabacab"] == list("aabacab")
    assert made == ["a", "b", "c", "b"]
    shared.forget()
    assert use("b") == "b" and made[4:] == ["b"]


def test_forgotten_memory_goes_back_to_the_system():
    def resident():
        return int(re.search(r"VmRSS:\s+(\d+)", pathlib.Path("/proc/self/status").read_text())[1])

    before = resident()
    shared.per_process("many bytes", lambda: [bytes(1000) for _ in range(200_000)])
    kept = [bytes(900) for _ in range(10)]  # noqa: F841 lies above what is freed
    assert resident() - before > 150_000
    shared.forget()
    assert resident() - before < 50_000


def written(spark):
    """The steps that lie in the shared folder now."""
    return set(pathlib.Path(shared.scratch(spark)).glob("presswork/*"))


def test_steps_inside_go_when_the_result_is_stored(spark):
    before = written(spark)
    outside = shared.stored(spark.range(4), "outside")

    def inner():
        return shared.stored(spark.range(3), "step").union(outside)

    def outer():
        return shared.lasting("inner", inner).union(shared.stored(spark.range(1), "step"))

    df = shared.lasting("result", outer)
    assert df.count() == 8 and outside.count() == 4
    assert sorted(p.name.rpartition("-")[0] for p in written(spark) - before) == ["outside", "result"]
    assert shared.lasting("none", lambda: shared.discard(shared.stored(spark.range(1), "step"))) is None
    shared.stored(spark.range(2), "later")
    assert len(written(spark) - before) == 3
