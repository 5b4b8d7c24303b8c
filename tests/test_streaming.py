import json

from ledgerstone.streaming import ingest
from tests.test_statements import PAGE


def test_each_content_is_parsed_once(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "ck")
    folder.mkdir()
    put = lambda name, page: (folder / f"{name}.json").write_text(json.dumps({"filename": name, "pages": [page]}))
    put("a", PAGE)
    put("b", PAGE)
    ingest.start(spark, str(folder), store, checkpoint).awaitTermination()
    assert spark.read.parquet(store).count() == 1
    put("c", PAGE)
    put("d", PAGE.replace("8.10", "9.10"))
    ingest.start(spark, str(folder), store, checkpoint).awaitTermination()
    assert sorted(r.verdict for r in spark.read.parquet(store).collect()) == ["fail", "pass"]


def test_a_replayed_batch_and_a_late_twin_add_nothing(spark, tmp_path):
    folder, store, checkpoint = tmp_path / "in", tmp_path / "store", tmp_path / "ck"
    folder.mkdir()
    put = lambda name, page: (folder / f"{name}.json").write_text(json.dumps({"filename": name, "pages": [page]}))
    run = lambda: ingest.start(spark, str(folder), str(store), str(checkpoint)).awaitTermination()
    rows = lambda: sorted((r.filename, r.sha256) for r in spark.read.parquet(str(store)).collect())
    put("a", PAGE)
    run()
    put("b", PAGE.replace("8.10", "9.10"))
    run()
    before = rows()
    assert [r[0] for r in before] == ["a", "b"]
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    last.unlink()  # as if the driver was lost after the batch was written and before that was noted
    put("late", PAGE)
    run()
    assert rows() == before
