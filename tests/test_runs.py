"""Archives read by member ranges, file hashes, manifests, transitive lineage and the recomputation gate."""

import hashlib
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewell.operators import lineage, validate
from tidewell.sources import archives, files, panel, runs, shared

COLUMNS = ["t", "x", "label"]


def archive(path, members, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as f:
        for name, text in members:
            f.writestr(name, text)
    return str(path)


def read(spark, path, **how):
    return [(r.source, r.entity, r.row, r.t, r.x, r.label) for r in archives.read_archive(spark, path, COLUMNS, {"T": "t"}, **how).orderBy("entity", "row").collect()]


def test_each_member_is_read_by_its_own_header(spark, tmp_path):
    z = archive(tmp_path / "a.zip", [("setB/p2.psv", "label|x|t\r\n0|7|80\r\n"), ("top/setA/p1.psv", "T | x|label\n1|5|0\n\n2||1"), ("Dataset.csv", "no"), ("setA/", "")])
    assert read(spark, z) == [("setA", "setA:p1", 1, "1", "5", "0"), ("setA", "setA:p1", 2, "2", "", "1"), ("setB", "setB:p2", 1, "80", "7", "0")]
    members = archives.archive_members(spark, z)
    assert [r.name for r in members.collect()] == ["Dataset.csv", "setB/p2.psv", "top/setA/p1.psv"]
    assert panel.inventory_hash(members).first().members == 3
    out = panel.harmonised(archives.read_archive(spark, z, COLUMNS, {"T": "t"}), ["x"]).orderBy("entity", "t").collect()
    assert [(r.entity, r.t, r.x, r.label) for r in out] == [("setA:p1", 1.0, 5.0, 0), ("setA:p1", 2.0, None, 1), ("setB:p2", 80.0, 7.0, 0)]


@pytest.mark.parametrize(("text", "what"), [
    ("t|x\n1|2\n", "missing columns: .'label'"), ("t|x|label|hr\n1|2|0|9\n", "unknown columns: .'hr'"), ("t|T|x|label\n1|1|2|0\n", "duplicate columns: .'t'"),
    ("t|x|label\n1|2|0|9\n", "4 cells below 3"), ("t|x|label\n", "no rows"), ("", "missing columns|unknown columns"),
])
def test_wrong_members_are_named(spark, tmp_path, text, what):
    z = archive(tmp_path / "a.zip", [("setA/p1.psv", "t|x|label\n1|5|0\n"), ("setB/p9.psv", text)])
    with pytest.raises(Exception, match=f"(?s)setB/p9.psv: .*({what})"):
        read(spark, z)


def test_wrong_archives_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="no .psv files"):
        read(spark, archive(tmp_path / "a.zip", [("Dataset.csv", "no")]))
    with pytest.raises(Exception, match="two files of entity setA:p1"):
        read(spark, archive(tmp_path / "b.zip", [("setA/p1.psv", "t|x|label\n1|5|0\n"), ("x/setA/p1.psv", "t|x|label\n2|5|0\n")]))
    with pytest.raises(Exception, match="no source and entity"):
        read(spark, archive(tmp_path / "c.zip", [("p1.psv", "t|x|label\n1|5|0\n")]))
    z = archive(tmp_path / "d.zip", [("setA/p1.psv", "t|x|label\n1|5|0\n")], zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "d.zip").read_bytes())
    data[data.index(b"1|5|0")] = ord("2")
    (tmp_path / "d.zip").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        read(spark, z)


def test_tasks_share_one_archive(spark, tmp_path):
    from pyspark import TaskContext
    from pyspark.sql.types import LongType

    many = [(f"set{k % 3}/p{k}.psv", "t|x|label\n" + "".join(f"{i}|{i * k}|0\n" for i in range(1, 400))) for k in range(60)]
    z = archive(tmp_path / "a.zip", many)
    df = archives.read_archive(spark, z, COLUMNS, partition_bytes=20_000)
    where = F.udf(lambda: TaskContext.get().partitionId(), LongType()).asNondeterministic()
    got = df.withColumn("task", where()).groupBy("entity").agg(F.count("*").alias("n"), F.countDistinct("task").alias("tasks"), F.max("task").alias("task")).collect()
    assert len(got) == 60 and {r.n for r in got} == {399} and {r.tasks for r in got} == {1} and len({r.task for r in got}) > 2


def test_a_long_member_is_unpacked_as_a_stream(tmp_path):
    lines = [f"{i}|{'y' * 90}|0" for i in range(60_000)]
    z = archive(tmp_path / "a.zip", [("setA/p1.psv", "\n".join(["t|x|label", *lines]))])
    (m,) = archives.directory(z)
    with open(z, "rb") as f:
        assert list(archives.lines_of(f, m)) == ["t|x|label", *lines]


def test_written_archives_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("A", f"A:{e}", t, float(e * t) if t % 2 else None, 0) for e in range(30) for t in range(1, 6)], "source string, entity string, t long, x double, label int")
    path = str(tmp_path / "out")
    archives.write_archive(rows, path)
    archives.write_archive(rows.withColumn("source", F.lit("B")).withColumn("entity", F.regexp_replace("entity", "A", "B")), path)  # more are added
    assert all(n.endswith(".zip") for n in os.listdir(path))
    got = read(spark, path)
    assert len(got) == 300 and ("A", "A:7", 3, "3", "21.0", "0") in got and ("B", "B:7", 2, "2", "", "0") in got
    with pytest.raises(Exception, match="twice"):
        rows.coalesce(1).orderBy("t").write.format(archives.NAME).mode("append").save(str(tmp_path / "bad"))
    assert not [n for n in os.listdir(tmp_path / "bad") if n.endswith(".zip")]


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "0" * 64) for a, b in pairs], "node string, input string, sha256 string")


def test_a_change_marks_everything_behind_it(spark):
    pairs = [("features", "panel"), ("model", "features"), ("scores", "model"), ("figures", "scores"), ("figures", "panel"), ("notes", "readme"), ("loop1", "loop2"), ("loop2", "loop1"), ("loop1", "scores")]
    changed = spark.createDataFrame([("panel",)], "artifact string")
    got = {r.artifact: r.steps for r in lineage.behind(edges_of(spark, pairs), changed).collect()}
    assert got == {"panel": 0, "features": 1, "figures": 1, "model": 2, "scores": 3, "loop1": 4, "loop2": 5}
    assert {(r.node, r.input) for r in lineage.cyclic(edges_of(spark, pairs)).collect()} == {("loop1", "loop2"), ("loop2", "loop1")}
    assert lineage.cyclic(edges_of(spark, pairs[:6])).isEmpty()


def test_rounds_move_new_artifacts_alone(spark, monkeypatch):
    plans, add = [], shared.Bucketed.add

    def watched(self, df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return add(self, df)

    monkeypatch.setattr(shared.Bucketed, "add", watched)
    monkeypatch.setattr(lineage, "BUCKET_EDGES", 20)
    chain = [(f"a{k + 1}", f"a{k}") for k in range(6)]
    fan = [(f"b{k}", "a2") for k in range(40)] + [(f"c{k}", f"b{k}") for k in range(40)]
    pairs = chain + fan + fan + [("a3", "a3"), ("a1", "a4"), ("c0", "a0"), ("z", "y")]
    want = {f"a{k}": k for k in range(7)} | {f"b{k}": 3 for k in range(40)} | {f"c{k}": 4 for k in range(40)} | {"c0": 1}
    changed = spark.createDataFrame([("a0",), ("a0",)], "artifact string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lineage.behind(edges_of(spark, pairs), changed)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.count() == len(want) and {r.artifact: r.steps for r in got.collect()} == want
    assert got.dtypes == [("artifact", "string"), ("steps", "int")]
    edges, _, *rounds = plans
    assert len(rounds) == 7 and edges.count("Exchange ") == 1
    assert all(p.count("Exchange ") == 1 and p.count("SortMergeJoin") == 2 and "Bucketed: true" in p for p in rounds)  # of the artifacts found, not of edges or known ones
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("tidewell_")]


def test_stale_artifacts(spark):
    h = {n: str(k) * 64 for k, n in enumerate(["panel", "features", "model", "scores"])}
    nodes = spark.createDataFrame(list(h.items()), "artifact string, sha256 string")
    edges = spark.createDataFrame([("features", "panel", h["panel"]), ("model", "features", h["features"]), ("scores", "model", "f" * 64)], "node string, input string, sha256 string")
    now = nodes.withColumn("sha256", F.when(F.col("artifact") == "panel", "e" * 64).otherwise(F.col("sha256")))
    assert {(r.artifact, r.what, r.steps) for r in lineage.stale(nodes, edges, now).collect()} == {("panel", "mismatch", 0), ("features", "behind a change", 1), ("model", "behind a change", 2), ("scores", "made of other input", 0)}
    assert {r.artifact for r in lineage.stale(nodes, edges.limit(2), nodes).collect()} == set()


def test_a_tampered_figure_is_refused(spark, tmp_path):
    figures = spark.createDataFrame([("a", 0.5), ("b", 0.25), ("c", None)], "k string, v double")
    raw = runs.write_once(figures, str(tmp_path / "figures"))
    stages = spark.createDataFrame([("report", "figures", "1" * 64, 10)], runs.STAGE)
    uses = spark.createDataFrame([], "stage string, uses string")
    again = {"figures": (figures, ["k"])}
    assert runs.gate({"figures": raw}, again, stages, stages, uses, str(tmp_path / "final")).count() == 1
    for bad in (raw.withColumn("v", F.col("v") + 1e-9), raw.filter("k <> 'a'"), raw.fillna(0.0), raw.union(spark.createDataFrame([("d", 1.0)], raw.schema))):
        with pytest.raises(validate.Violation, match="not what they are made of"):
            runs.gate({"figures": bad}, again, stages, stages, uses, str(tmp_path / "never"))
    with pytest.raises(validate.Violation, match="columns differ"):
        runs.recomputed({"figures": raw.withColumn("v", F.col("v").cast("string"))}, again)
    with pytest.raises(validate.Violation, match="one side"):
        runs.recomputed({}, again)
    assert not os.path.exists(tmp_path / "never")


def test_files_are_hashed_in_pieces_and_links_refused(spark, tmp_path):
    root = tmp_path / "run"
    (root / "deep").mkdir(parents=True)
    big = os.urandom(3 * files.PIECE + 17)
    (root / "deep/big").write_bytes(big)
    (root / "empty").write_bytes(b"")
    want = {f"{root}/deep/big": (hashlib.sha256(big).hexdigest(), len(big)), f"{root}/empty": (hashlib.sha256(b"").hexdigest(), 0)}
    df = files.file_hashes(spark, str(root), partition_bytes=1)
    assert {r.artifact: (r.sha256, r.size) for r in df.collect()} == want and df.rdd.getNumPartitions() == 2
    (tmp_path / "elsewhere").mkdir()
    for name, to in (("link", root / "empty"), ("deep/folder", tmp_path / "elsewhere")):
        (root / name).symlink_to(to)
        with pytest.raises(validate.Violation, match="links among"):
            files.file_hashes(spark, str(root))
        (root / name).unlink()


def test_json_manifests_fail_closed(spark, tmp_path):
    schema = "stage string, rows long, inputs map<string,string>"
    (tmp_path / "a.json").write_text(json.dumps({"stage": "prepare", "rows": 3, "inputs": {"x": "0"}}, indent=2))
    (tmp_path / "notes.txt").write_text("no")
    got = files.json_manifests(spark, str(tmp_path), schema, ["stage", "rows"]).first()
    assert (got.stage, got.rows, got.inputs) == ("prepare", 3, {"x": "0"}) and got.artifact.endswith("a.json")
    for bad, what in (('{"stage": "x"}', "required"), ('{"stage": "x", "rows": "many"}', "(?i)malformed|parse"), ("{", "(?i)malformed|parse|corrupt")):
        (tmp_path / "b.json").write_text(bad)
        with pytest.raises(Exception, match=what):
            files.json_manifests(spark, str(tmp_path), schema, ["stage", "rows"]).collect()


def test_csv_reads_back_as_it_was(spark, tmp_path):
    rows = [(1, 0.1 + 0.2, "a,b"), (2, 1e-300, 'say "x"'), (3, None, "é\nline"), (4, -1 / 3, None), (5, 5e-324, "plain")]
    df = spark.createDataFrame(rows, "k int, v double, s string")
    again = files.write_csv_once(df, str(tmp_path / "t"))
    assert sorted(map(tuple, again.collect())) == rows
    with pytest.raises(Exception, match="(?i)already exists"):
        files.write_csv_once(df, str(tmp_path / "t"))


def test_binary_columns_are_checked_before_they_are_cast(spark):
    of = lambda *v: spark.createDataFrame([(x,) for x in v], "y double")
    assert [r.y for r in files.binary_column(of(0.0, 1.0), "y").collect()] == [0, 1]
    for bad in ((0.0, 0.5), (1.0, None), (2.0,), (float("nan"),), ()):
        with pytest.raises(validate.Violation, match="y"):
            files.binary_column(of(*bad), "y")
