"""The verdict cache under several writers."""

import threading

from pyspark.sql import functions as F

from marginalia.schemas import VERDICT
from marginalia.sources import verdict_cache
from marginalia.sources.verdict_cache import VerdictCache


def entries(spark, names):
    return spark.createDataFrame([(n,) for n in names], "id string").withColumn("verdict", F.lit(None).cast(VERDICT))


def put(cache, names, stored):
    cache.put(entries(cache.spark, names), F.lit("s"), F.lit(stored).cast("timestamp"))


def held(cache):
    return {(r.salt, r.id): r.stored.timestamp() for r in verdict_cache.latest(cache.read()).collect()}


def test_the_newest_entry_wins_before_and_after_compaction(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "c"))
    assert cache.stats() == 0 and cache.parts() == []
    put(cache, ["a", "b"], 100)
    put(cache, ["b", "c"], 300)
    put(cache, ["b"], 200)
    want = {("s", "a"): 100.0, ("s", "b"): 300.0, ("s", "c"): 300.0}
    assert held(cache) == want and len(cache.parts()) == 3
    cache.compact()
    assert held(cache) == want and len(cache.parts()) == 1 and cache.read().count() == 3
    assert cache.vacuum() == 0  # earlier versions still list them
    cache.clear()
    assert cache.stats() == 0


def test_reading_does_not_grow_with_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(verdict_cache, "MOST_PARTS", 3)
    monkeypatch.setattr(verdict_cache, "KEPT_VERSIONS", 2)
    cache = VerdictCache(spark, str(tmp_path / "c"))
    for k in range(9):
        put(cache, ["a", f"k{k}"], 100 + k)
        assert len(cache.parts()) <= 4
    assert cache.stats() == 10 and len(cache.versions()) <= 4
    assert cache.vacuum() > 0 and cache.stats() == 10


def test_two_writers_lose_nothing(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "c"))
    errors = []

    def work(name):
        try:
            for k in range(4):
                put(VerdictCache(spark, cache.directory), [f"{name}{k}"], k)
                if k == 2:
                    VerdictCache(spark, cache.directory).compact()
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    writers = [threading.Thread(target=work, args=(name,)) for name in "xyz"]
    for writer in writers:
        writer.start()
    for writer in writers:
        writer.join()
    assert not errors and {n for _, n in held(cache)} == {f"{name}{k}" for name in "xyz" for k in range(4)}


def test_a_compaction_that_comes_too_late_changes_nothing(spark, tmp_path, monkeypatch):
    cache = VerdictCache(spark, str(tmp_path / "c"))
    put(cache, ["a"], 1)
    put(cache, ["b"], 2)
    write = VerdictCache._write

    def slow(self, rows):
        part = write(self, rows)
        monkeypatch.setattr(VerdictCache, "_write", write)
        cache.clear()
        put(cache, ["c"], 3)
        return part

    monkeypatch.setattr(VerdictCache, "_write", slow)
    cache.compact()
    assert {n for _, n in held(cache)} == {"c"}


def test_a_version_that_was_never_finished_is_passed_over(spark, tmp_path):
    cache = VerdictCache(spark, str(tmp_path / "c"))
    put(cache, ["a"], 1)
    (tmp_path / "c" / "verdicts" / "versions" / f"{cache.versions()[-1] + 1:012d}").write_text("{")
    assert {n for _, n in held(cache)} == {"a"}
    put(cache, ["b"], 2)
    assert {n for _, n in held(cache)} == {"a", "b"}
