import json

from pathloom import cli
from pathloom.operators import flatten, stats
from pathloom.streaming import profile


def test_running_counts_equal_the_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    docs = [{"a": k, "b": {"c": None if k % 2 else "x"}, "t": f"2024-01-01 00:00:{k:02d}"} for k in range(20)]
    for part in range(2):
        (tmp_path / "in" / f"{part}.jsonl").write_text("".join(json.dumps(d) + "\n" for d in docs[part::2]))
    stream = profile.document_stream(spark, str(tmp_path / "in"))
    query = profile.start(profile.running_path_counts(stream, 2), "path_counts", str(tmp_path / "state"))
    query.processAllAvailable()
    query.stop()
    batch = stats.path_counts(flatten.flatten(flatten.parse_documents(spark.createDataFrame([(k, json.dumps(d)) for k, d in enumerate(docs)], "doc_id long, doc string"))))
    assert sorted(map(str, spark.table("path_counts").collect())) == sorted(map(str, batch.collect()))
    query = profile.start(profile.windowed_path_counts(stream, 2, "$.t", "10 seconds", "1 minute"), "windows", str(tmp_path / "state2"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r["count"] for r in spark.table("windows").where("typed_path = 'a_num'").collect()) == [10, 10]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps([{"a": k % 3, "b": "x"} for k in range(9)]))
    cli.main(["stats", str(tmp_path / "d.json"), str(tmp_path / "stats"), "h"], spark)
    rows = {r["path"]: r for r in spark.read.json(str(tmp_path / "stats/stats")).collect()}
    assert rows["a_num"]["ndv"] == 3 and rows["a_num"]["hist_type"] == "SINGLETON"
    cli.main(["experiment", str(tmp_path / "d.json"), str(tmp_path / "grid"), "--most", "1"], spark)
    cli.main(["summary", str(tmp_path / "grid")], spark)
    assert "exists" in capsys.readouterr().out
    assert cli.stat_type("ndv").value == "BASIC_NDV" and cli.stat_type("BASIC").value == "BASIC"
