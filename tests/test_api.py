import threading

import pytest
from pyspark.sql import functions as F

from tuplemill import __main__ as cli
from tuplemill import api, rest
from tuplemill.sources import snapshot
from tuplemill.sources.spacedir import LockedError, SpaceDir


def test_connection(spark, tmp_path):
    db = api.create("t1", spark.createDataFrame([(5, "a"), (3, None), (4, "c")], "n int, s string"))
    try:
        with pytest.raises(ValueError):
            api.create("t1", spark.range(1))
        assert sorted(r.rid for r in db.records.collect()) == [0, 1, 2] and db.find("n", "=", 5).s == "a"
        before = db.records
        db.start_logging(f"file://{tmp_path}/log")
        db.insert([{"n": 9, "s": "z"}, {"n": 8}])
        db.update({"s": "new"}, [("n", "<", 5)])
        assert db.delete([("n", "=", 9)]) == 1
        db.stop_logging()
        rows = sorted((r.n, r.s) for r in db.records.collect() if r.s) + [r.n for r in db.records.collect() if r.s is None]
        assert rows == [(3, "new"), (4, "new"), (5, "a"), 8] and db.size() == 4
        other = api.create("t2", before)
        other.replay_log(f"file://{tmp_path}/log")
        assert sorted(map(tuple, other.records.select("rid", "n", "s").collect()), key=str) == sorted(map(tuple, db.records.select("rid", "n", "s").collect()), key=str)
        db.dump(f"file://{tmp_path}/dump")
        assert api.load("t3", spark, f"file://{tmp_path}/dump").size() == 4
        index = db.create_index(f"file://{tmp_path}/ix", ["n"])
        assert db.index_id(["n"]) == index and db.catalog.select([("n", ">", 4)]).count() == 2
        assert db.query([("s", "=", "new")], limit=1).fetchone().s == "new" and db.get(0) is not None
        db.close()
    finally:
        for name in ("t1", "t2", "t3"):
            api.drop(name)
    with pytest.raises(KeyError):
        api.attach("t1")


def test_ids_begin_after_zero(spark):
    db = api.create("t4", spark.createDataFrame([(0, "a")], "rid long, s string"))
    try:
        db.insert([{"s": "b"}, {"s": "a"}])
        assert sorted((r.rid, r.s) for r in db.records.collect()) == [(0, "a"), (1, "b"), (2, "a")]
        db.delete([("rid", ">=", 0)])
        db.insert([{"s": "c"}])
        assert [tuple(r) for r in db.records.collect()] == [(0, "c")]
    finally:
        api.drop("t4")


def test_later_connections_log_after_earlier_ones(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a")], "rid long, s string")
    one = api.create("t5", rows)
    try:
        path = f"file://{tmp_path}/log"
        one.start_logging(path)
        for text in ("b", "c"):
            one.update({"s": text})
        two = api.attach("t5")
        two.start_logging(path)
        two.update({"s": "d"})
        copy = api.create("t6", rows)
        copy.replay_log(path)
        assert [tuple(r) for r in copy.records.collect()] == [(0, "d")]
    finally:
        api.drop("t5")
        api.drop("t6")


def test_one_writer_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(api, "LOCK_SECONDS", 0.2)
    db = api.create("t7", spark.createDataFrame([(0, "a")], "rid long, s string"))
    try:
        failed = []

        def other():
            try:
                api.attach("t7").update({"s": "z"})
            except api.LockedError as e:
                failed.append(e)

        with db.writing():
            thread = threading.Thread(target=other)
            thread.start()
            thread.join()
            db.update({"s": "b"})
        assert len(failed) == 1 and db.records.first().s == "b"
        other()
        assert db.records.first().s == "z"
    finally:
        api.drop("t7")


def test_indexes_follow_a_connection(spark, tmp_path):
    db = api.create("t8", spark.createDataFrame([(k, k % 5, f"s{k}") for k in range(40)], "rid long, n long, s string"))
    try:
        index = db.create_index(f"file://{tmp_path}/n", ["n"])
        db.insert([{"n": 3, "s": "new"}])
        db.update({"n": 9}, [("s", "=", "s3")])
        db.delete([("s", "=", "s8")])
        assert db.indexes() == [index] and db.info()["rows"] == 40
        for value, want in ((3, {"new", "s13", "s18", "s23", "s28", "s33", "s38"}), (9, {"s3"})):
            assert {r.s for r in db.catalog.select([("n", "=", value)]).collect()} == want
        db.drop_index(index)
        assert db.indexes() == []
    finally:
        api.drop("t8")


def test_service(spark):
    service = rest.Service(spark)
    ask = lambda text: service.handle(f"{text}&db=4242")
    assert ask("op=create&fields=2") == "1"
    try:
        assert ask("op=insert&rec=1,a&rec=2,b&rec=3,c") == "[0,1,2]" and ask("op=insert&rec=4&jsonp=f") == "f([3]);"
        assert ask("op=count") == "4" and ask("op=update&field=1&value=b&ufield=1&uvalue=z&type=str") == "1"
        assert ask("op=delete&recids=0,3") == "2"
        assert ask("op=search&showid=yes") == '[[1,"2","z"],\n[2,"3","c"]]'
        with pytest.raises(ValueError):
            ask("op=create")
        with pytest.raises(ValueError):
            ask("op=nonsense")
    finally:
        ask("op=drop")
    with pytest.raises(KeyError):
        ask("op=count")


def test_command_line(spark, tmp_path):
    said = []
    space, at = f"file://{tmp_path}/space", lambda name: f"file://{tmp_path}/{name}"
    ask = lambda command, *rest: (said.clear(), cli.run(spark, space, command, list(rest), said.append), list(said))[1:]
    ask("create", "a bigint, b string")
    for row in (("1", "x"), ("2", "y"), ("3",), ("2", "z")):
        ask("add", *row)
    assert ask("count")[1] == ["4"] and ask("createindex", "a")[1] == ["1"] and ask("createhash", "a", "b")[1] == ["2"]
    assert ask("listindex")[1] == ["1\tsorted\ta", "2\thashed\ta,b"]
    ask("add", "2", "w")
    assert ask("query", "a", "=", "2")[1][0] == "rid\ta\tb" and len(said) == 4
    assert ask("del", "b", "=", "y")[1] == ["1"] and ask("count", "a", "=", "2")[1] == ["2"] and ask("count", "a", "=", "2", "b", "=", "w")[1] == ["1"]
    assert ask("select", "2", "1")[1] == ["rid\ta\tb", "2\t3\tNULL", "3\t2\tz"]
    ask("dropindex", "1")
    assert '"indexes": 1' in ask("info")[1][0]
    ask("export", at("dump"))
    assert cli.run(spark, at("copy"), "import", [at("dump")], said.append) == 0 and cli.run(spark, at("copy"), "count", [], said.append) == 0 and said[-1] == "4"
    ask("exportcsv", at("csv"))
    cli.run(spark, at("again"), "importcsv", [at("csv/part-*")], said.append)
    cli.run(spark, at("again"), "count", ["f0", "=", "2"], said.append)
    with pytest.raises(ValueError):
        ask("nonsense")
    ask("free")
    with pytest.raises(FileNotFoundError):
        ask("add", "1")
    (tmp_path / "rules.txt").write_text("k(1). -k(?X) | r(?X). -r(1).")
    assert cli.run(spark, at("rules"), "importotter", [at("rules.txt")], said.append) == 0 and cli.run(spark, at("rules"), "runreasoner", [], said.append) == 0 and said[-1] == "proof"
    (tmp_path / "docs.json").write_text('{"k": 1}\n{"k": 2}\n')
    cli.run(spark, at("docs"), "addjson", [at("docs.json")], said.append)
    cli.run(spark, at("docs"), "findjson", ['{"k": 2}'], said.append)
    assert said[-2:] == ["doc_id", "1"]
    (tmp_path / "x.nt").write_text('<http://a/s> <http://a/p> "v" .\n')
    cli.run(spark, at("rdf"), "importrdf", [at("x.nt")], said.append)
    cli.run(spark, at("rdf"), "exportrdf", [at("nt")], said.append)
    assert next((tmp_path / "nt").glob("part*")).read_text() == '<http://a/s> <http://a/p> "v" .\n'
    assert cli.main(["help"]) == 0 and cli.main(["version"]) == 0 and cli.main([]) == 0


def test_folders_have_one_writer_and_replay(spark, tmp_path):
    space = SpaceDir(spark, f"file://{tmp_path}/s", wait=0.1)
    space.create(spark.createDataFrame([(0, "a"), (1, "b")], "rid long, s string"))
    with space.writing(), pytest.raises(LockedError):
        SpaceDir(spark, space.path, wait=0.1).delete([("rid", "=", 0)])
    spark.createDataFrame([(1, "SET", 1, "s", "z"), (2, "DEL", 0, None, None)], snapshot.JOURNAL).write.parquet(f"file://{tmp_path}/log")
    space.create_index(["s"])
    space.replay(f"file://{tmp_path}/log")
    assert [tuple(r) for r in space.query([("s", "=", "z")]).collect()] == [(1, "z")] and len(space.versions()) == 2
    spark.range(1).write.parquet(f"file://{tmp_path}/s/data-9")
    (tmp_path / "s/data-9/_SUCCESS").unlink()  # a writer died
    assert space.records().count() == 1


def test_constructors(spark):
    row = spark.range(1).select(api.kvpair("k", 1).alias("kv"), api.array(1, "x", None).alias("a"), api.json_object(x=1.5, y="z").alias("o")).first()
    assert row.kv.subject.t == 1 and row.kv.object.i == 1 and [v.t for v in row.a] == [3, 5, 1] and [m.property.s for m in row.o] == ["x", "y"]
    assert spark.range(1).select(F.size(api.array())).first()[0] == 0
