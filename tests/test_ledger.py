"""Batches taken in once, whatever comes again."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources.ledger import Store, digest

SCHEMA = "k int, day string, a double, b string"


def store(spark, path, **more):
    return Store(spark, str(path), SCHEMA, ["k", "day"], {"a_negative": F.coalesce(F.col("a"), F.lit(0.0)) >= 0}, **more)


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def held(s):
    return {(r.k, r.day): (r.a, r.b) for r in s.current().collect()}


FIRST = [(1, "x", 1.0, "p"), (2, "x", 2.0, None), (3, "x", -1.0, "bad"), (None, "x", 1.0, "bad"), (1, "x", 9.0, "again")]


def test_accounting_and_replays(spark, tmp_path):
    s = store(spark, tmp_path)
    one = s.ingest(rows(spark, FIRST), "crm", "b1", order=["a"])
    assert {c: one[c] for c in ("rows_in", "accepted", "rejected", "repeated", "inserted", "updated", "unchanged", "replay")} == {"rows_in": 5, "accepted": 2, "rejected": 2, "repeated": 1, "inserted": 2, "updated": 0, "unchanged": 0, "replay": False}
    assert held(s) == {(1, "x"): (1.0, "p"), (2, "x"): (2.0, None)}
    again = s.ingest(rows(spark, FIRST[::-1]), "crm", "b1", order=["a"])
    assert again["replay"] and not again["changed"] and all(again[c] == one[c] for c in ("seq", "digest", "accepted", "inserted"))
    other = s.ingest(rows(spark, [(1, "x", 77.0, "q")]), "crm", "b1")
    assert other["replay"] and other["changed"] and held(s)[1, "x"] == (1.0, "p") and s.ledger().count() == 1
    # the same content under another id, or from another source, is a batch of its own
    two = s.ingest(rows(spark, FIRST), "crm", "b2", order=["a"])
    assert (two["inserted"], two["updated"], two["unchanged"], two["replay"]) == (0, 0, 2, False)


def test_merging_and_replacing(spark, tmp_path):
    s = store(spark, tmp_path)
    s.ingest(rows(spark, [(1, "x", 1.0, "p"), (2, "x", 2.0, "q")]), "crm", "1")
    merged = s.ingest(rows(spark, [(1, "x", None, "r"), (2, "x", None, None), (3, "x", 3.0, None)]), "crm", "2")
    assert (merged["inserted"], merged["updated"], merged["unchanged"]) == (1, 1, 1)
    assert held(s) == {(1, "x"): (1.0, "r"), (2, "x"): (2.0, "q"), (3, "x"): (3.0, None)}
    replaced = s.ingest(rows(spark, [(1, "x", None, "s"), (2, "x", 2.0, "q")]), "crm", "3", mode="replace")
    assert (replaced["updated"], replaced["unchanged"]) == (1, 1) and held(s)[1, "x"] == (None, "s")
    with pytest.raises(ValueError):
        s.ingest(rows(spark, []), "crm", "4", mode="other")


def test_validation_writes_nothing(spark, tmp_path):
    s = store(spark, tmp_path)
    told = s.ingest(rows(spark, FIRST), "crm", "b1", validate_only=True, order=["a"])
    assert (told["accepted"], told["rejected"], told["inserted"]) == (2, 2, 2) and s.ledger().count() == 0 and held(s) == {}
    assert s.ingest(rows(spark, FIRST), "crm", "b1", order=["a"])["replay"] is False and len(held(s)) == 2
    assert s.ingest(rows(spark, []), "crm", "none")["rows_in"] == 0


def test_a_failure_between_rows_and_ledger(spark, tmp_path):
    s = store(spark, tmp_path)
    s.ingest(rows(spark, [(1, "x", 1.0, "p")]), "crm", "1")

    class Broken(Store):
        def _commit(self, account):
            raise OSError("gone")

    broken = Broken(spark, s.path, SCHEMA, ["k", "day"])
    with pytest.raises(OSError):
        broken.ingest(rows(spark, [(1, "x", 5.0, "z"), (2, "x", 6.0, "y")]), "crm", "2")
    assert held(s) == {(1, "x"): (1.0, "p")} and s.ledger().count() == 1
    done = s.ingest(rows(spark, [(1, "x", 5.0, "z"), (2, "x", 6.0, "y")]), "crm", "2")
    assert not done["replay"] and (done["inserted"], done["updated"]) == (1, 1) and held(s) == {(1, "x"): (5.0, "z"), (2, "x"): (6.0, "y")}


def test_digests_see_rows_and_not_their_order(spark):
    a = rows(spark, [(1, "x", 1.0, "p"), (2, "x", None, ""), (2, "x", None, "")])
    assert digest(a) == digest(a.orderBy(F.desc("k")).repartition(3)) != digest(a.distinct())
    assert digest(rows(spark, [(2, "x", None, "")])) != digest(rows(spark, [(2, "x", None, None)]))


def test_a_stream_run_again_from_the_start_changes_nothing(spark, tmp_path):
    for k in range(3):
        rows(spark, [(i, "x", float(k), f"b{k}") for i in range(k, k + 3)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = store(spark, tmp_path / "store")
    read = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s.ingest_stream(read(), "feed", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination()
    one = held(s)
    assert len(one) == 5 and s.ledger().count() == 3
    s.ingest_stream(read(), "feed", str(tmp_path / "c2")).trigger(availableNow=True).start().awaitTermination()
    assert held(s) == one and s.ledger().count() == 3
