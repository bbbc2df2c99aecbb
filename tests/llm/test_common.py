import gc
import os
import weakref

from hardwood.llm import mixing
from hardwood.llm import common
from hardwood.llm.common import Scratch, scratch_scope
from tests.llm.helpers import frame, many_partitions, odd_documents


def test_scope_clears_what_was_written_inside(spark, tmp_path):
    outside = Scratch(spark, "outside")
    outside.keep(spark.range(3), "kept")
    folder = outside.root.removeprefix("file://")
    before = set(os.listdir(os.path.dirname(folder)))
    with scratch_scope():
        inside = Scratch(spark, "inside")
        inside.keep(spark.range(3), "kept")
        mixing.mixed_documents(frame(spark, odd_documents())).write.parquet(f"{tmp_path}/out")
    assert os.path.isdir(folder) and not os.path.exists(inside.root.removeprefix("file://"))
    assert set(os.listdir(os.path.dirname(folder))) == before
    outside.clear()
    assert not os.path.exists(folder) and spark.read.parquet(f"{tmp_path}/out").count()


def test_release_lets_go_of_plans_in_cycles(spark):
    """Python's handles of finished steps, which keep their plans alive in the JVM, are collected."""
    df = spark.range(3)
    held = [df]
    held.append(held)
    gone = weakref.ref(df)
    gc.disable()
    try:
        del df, held
        assert gone() is not None
        Scratch(spark, "release").release()
        assert gone() is None
    finally:
        gc.enable()


def test_thrifty_steps_give_back_once_their_rows_are_out(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    out = common.thrifty(lambda batches: (x + 1 for x in batches))(iter([1, 2]))
    assert next(out) == 2 and not calls
    assert list(out) == [3] and calls == [1]


def test_give_back():
    common.give_back()


def test_packed_tables_have_few_files(spark):
    """A task takes several shuffle partitions, and no file has a .crc file beside it; no row is lost."""
    plain, few, n = Scratch(spark, "plain"), Scratch(spark, "few", pack=True), 400
    with many_partitions(spark, n):
        df = spark.range(5000).repartition("id")
        kept = {"plain": plain.keep(df, "t"), "few": few.keep(df, "t"), "rows": few.keep(df, "t", as_dealt=True)}
    assert all(k.count() == k.distinct().count() == 5000 for k in kept.values())
    files = {name: os.listdir(k._hardwood_path.removeprefix("file://")) for name, k in kept.items()}
    parts = {name: sum(f.endswith(".parquet") for f in found) for name, found in files.items()}
    assert parts["plain"] == parts["rows"] == n
    assert parts["few"] == max(common.WAVES * spark.sparkContext.defaultParallelism, n // common.PACK)
    assert not any(f.endswith(".crc") for f in files["few"] + files["rows"])
    plain.clear()
    few.clear()
