import duckdb
import pytest

from jobs import observe

CONFIG = {
    "id": "doc_id", "group": "source", "parts": 3, "files_per_batch": 1,
    "predicates": {"1": "length(coalesce(text, '')) >= 5", "2": "position('@' in coalesce(text, '')) > 0", "3": "lang = 'en'", "4": "lang <> 'en'", "5": "1 = 1"},
    "relations": [[1, 2, 3], [3, 4, 5], [2, 4]],
}
SCHEMA = "doc_id long, text string, lang string, source string"
FIRST = [(1, "hello@x", "en", "a"), (2, "hi", "en", "a"), (3, None, "de", "b"), (4, "", "en", None), (5, "x" * 200000, None, ""), (1, "hello@x", "en", "a")]
SECOND = [(6, "again", "de", "a"), (7, "@", "en", "c"), (8, "long enough", "en", None)]
THIRD = [(9, "@@@@@@", "fr", "b")]


def expected(rows):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    return sorted(con.sql(observe.sql(CONFIG)).fetchall(), key=repr)


def got(frame):
    return sorted((tuple(r) for r in frame.select("group", "kind", "relation", "left_bit", "right_bit", "value", "n").collect()), key=repr)


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def folders(tmp_path):
    return f"file://{tmp_path}/documents", f"file://{tmp_path}/out"


def test_growing_input(spark, folders):
    """Each run takes only the new files, and leaves what one run over everything would."""
    documents, out = folders
    rows = []
    for new in (FIRST, SECOND, THIRD):
        put(spark, documents, new)
        rows += new
        assert got(observe.run(spark, documents, out, CONFIG)) == expected(rows)
        # every document is in the deltas once
        assert spark.read.parquet(f"{out}/deltas").where("relation = 0").groupBy().sum("n").first()[0] == len(rows)
        again = observe.run(spark, documents, out, CONFIG)
        assert got(again) == expected(rows)
    assert spark.read.parquet(f"{out}/state").where("relation = 0").groupBy().sum("n").first()[0] == len(rows)


def test_untouched_parts_are_not_rewritten(spark, folders):
    documents, out = folders
    put(spark, documents, FIRST)
    observe.run(spark, documents, out, CONFIG)
    mark = {r.part: r.upto for r in spark.read.parquet(f"{out}/constraints").select("part", "upto").distinct().collect()}
    put(spark, documents, THIRD)
    observe.run(spark, documents, out, CONFIG)
    part = {r.group: r.part for r in spark.read.parquet(f"{out}/state").select("group", "part").collect()}["b"]
    now = {r.part: r.upto for r in spark.read.parquet(f"{out}/constraints").select("part", "upto").distinct().collect()}
    assert now[part] == 1 and all(now[p] == mark[p] for p in mark if p != part)


@pytest.mark.parametrize("step", ["_replace", "fold", "refresh"])
def test_run_that_dies_is_made_good(spark, folders, monkeypatch, step):
    documents, out = folders
    put(spark, documents, FIRST)
    observe.run(spark, documents, out, CONFIG)
    put(spark, documents, SECOND)
    with monkeypatch.context() as m:
        if step == "_replace":  # dies between the state and the constraints
            real = observe._replace
            m.setattr(observe, step, lambda df, path, *parts: real(df, path, *parts) if not path.endswith("constraints") else 1 / 0)
        else:
            m.setattr(observe, step, lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            observe.run(spark, documents, out, CONFIG)
    assert got(observe.run(spark, documents, out, CONFIG)) == expected(FIRST + SECOND)


def test_batch_run_again_counts_once(spark, folders):
    """A batch whose record in the checkpoint was lost after its rows were written."""
    import shutil

    documents, out = folders
    put(spark, documents, FIRST)
    observe.run(spark, documents, out, CONFIG)
    put(spark, documents, SECOND)
    observe.read_new(spark, documents, out, CONFIG)
    commits = out.removeprefix("file://") + "/checkpoint/commits"
    for name in ("1", ".1.crc"):
        shutil.move(f"{commits}/{name}", f"{commits.removesuffix('/commits')}/gone-{name}")
    assert got(observe.run(spark, documents, out, CONFIG)) == expected(FIRST + SECOND)


def test_empty_table(spark, folders):
    documents, out = folders
    put(spark, documents, [])
    assert observe.run(spark, documents, out, CONFIG).collect() == []
    put(spark, documents, FIRST)
    assert got(observe.run(spark, documents, out, CONFIG)) == expected(FIRST)


def test_command_line(tmp_path):
    import os
    import subprocess
    import sys

    import pyarrow as pa
    import pyarrow.parquet as pq

    os.makedirs(tmp_path / "documents")
    pq.write_table(pa.table({"doc_id": [1], "text": ["hello@x"], "lang": ["en"], "source": ["a"]}), tmp_path / "documents/one.parquet")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    ran = subprocess.run([sys.executable, "-m", "jobs.observe", "--documents", str(tmp_path / "documents"), "--out", str(tmp_path / "out")], cwd=root, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert "read 1 documents" in ran.stderr
    assert pq.ParquetDataset(tmp_path / "out/constraints").read(columns=["kind"]).num_rows > 0
