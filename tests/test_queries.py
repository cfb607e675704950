from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinfold.functions import grids
from twinfold.plans.oracle import ORACLE
from twinfold.plans.queries import QUERIES
from twinfold.plans.storage import Scratch

SF = "/root/testdata/sf0.001"
TABLES = "orders events documents embeddings pages labels".split()


def same_rows(db, sql, frame):
    """Names and rows of a query are those of its SQL."""
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(frame.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in frame.collect()) == sorted(map(repr, found.fetchall()))


def tables(folder):
    db = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if Path(f'{folder}/{t}.parquet').is_dir() else ''}'")
    return db


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    same_rows(tables(SF), ORACLE[name], QUERIES[name](spark, SF))


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_empty_and_missing_texts(spark, tmp_path):
    """Empty texts are no copies of each other, and short ones have pictures too."""
    rows = [(1, "", "en", "s", 0), (2, "", "en", "s", 0), (3, None, "en", "s", None), (4, None, None, "s", None), (5, "é", "en", "s", 1), (6, "é", "de", "s", 1), (7, "ab" * 600, "en", "s", 1200), (8, "ab" * 600, "en", "s", 1200)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = tables(tmp_path)
    for name in ("exact_key_star_edges", "exact_key_groups", "group_members", "text_block_mean", "text_diff_hash_hex"):
        same_rows(db, ORACLE[name], QUERIES[name](spark, str(tmp_path)))


def test_group_members_has_whole_groups(spark, tmp_path):
    n = 2500
    texts = {i: "hot" if i % 2 else "twice" if i in (10, 4000) else f"own {i}" for i in range(2 * n)}
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for r in QUERIES["group_members"](spark, str(tmp_path)).collect():
        got.setdefault(r.primary_idx, []).append([int(x) for x in r.members.split(",")])
    assert [len(part) for part in sorted(got[1])] == [1000, 1000, 500]
    assert {k: sum(sorted(v), []) for k, v in got.items()} == {1: list(range(1, 2 * n, 2)), 10: [10, 4000]}


def test_text_pictures_read_every_byte():
    rnd = np.random.default_rng(4)
    for n in (1, 2, 31, 1023, 1024, 1025, 5000, 70001):
        data = rnd.integers(97, 123, n).astype(np.uint8)
        grid = grids.text_grid(data.tobytes().decode())
        for k in rnd.integers(0, 1024, 50):
            a, b = k * n // 1024, max((k + 1) * n // 1024, k * n // 1024 + 1)
            assert grid.ravel()[k] == data[a:b].astype(int).sum() // (b - a)
        assert n < 1024 or sum((k + 1) * n // 1024 - k * n // 1024 for k in range(1024)) == n
    assert not grids.text_grid(None).any() and not grids.text_grid("").any()


def test_urls_that_differ_after_the_path_have_their_own_image(spark, tmp_path):
    """Marks, empty queries and doubled slashes tell urls apart, and long ones are stored too."""
    urls = ["p", "p#a", "p#b", "p?", "p?#a", "/p", "", "?", "#", "/", "//", "x" * 199 + "/y", "x" * 400, "x" * 200, "x" * 400 + "?y"]
    rows = [(11 + k, f"https://h.example.com/{u}", f"<p>{'abcdefghij'[k % 10] * 300} {k} {u}</p>") for k, u in enumerate(urls)]
    spark.createDataFrame([r for r in rows if r[0] % 5], "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    same_rows(tables(tmp_path), ORACLE["image_replies"], QUERIES["image_replies"](spark, str(tmp_path)))


@pytest.mark.parametrize("name", ["hash_visuals", "text_block_mean", "transforms_restored", "dct_hash_hex", "text_diff_hash_hex", "haar_coefficients", "sql_functions"])
def test_pictures_are_made_a_few_rows_at_once(spark, name):
    """The last stage reads what was written with small batches and hands no grids to Python by the session's own."""
    assert "Python" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["image_files_hashed", "image_samples"])
def test_a_task_reads_many_small_files(spark, name, monkeypatch):
    """Files of a few hundred bytes aren't read by 32 a task, and the session's own settings are back after it."""
    tasks, save, cost = [], Scratch.save, spark.conf.get("spark.sql.files.openCostInBytes")
    monkeypatch.setattr(Scratch, "save", lambda self, frame, name: (tasks.append(frame.select("idx").rdd.getNumPartitions() if name == "found" else int(spark.conf.get("spark.sql.files.openCostInBytes"))), save(self, frame, name))[1])
    QUERIES[name](spark, SF)
    assert max(tasks) <= 16 << 10 and (name != "image_files_hashed" or tasks == [4])
    assert spark.conf.get("spark.sql.files.openCostInBytes") == cost


def test_a_batch_of_the_stream_is_read_by_many_tasks(spark, monkeypatch):
    """A batch lies in files of some rows each, however many rows it has; there are still four batches."""
    from twinfold.plans import queries
    from twinfold.streaming.incremental import IncrementalFinder

    met, on_batch = {}, IncrementalFinder.on_batch
    monkeypatch.setattr(queries, "STREAM_ROWS", 100, raising=False)
    monkeypatch.setattr(IncrementalFinder, "on_batch", lambda self, batch, k: (met.update({k: len(batch.select(F.input_file_name()).distinct().collect())}), on_batch(self, batch, k))[1])
    same_rows(tables(SF), ORACLE["streamed_groups"], QUERIES["streamed_groups"](spark, SF))
    assert len(met) == 4 and all(n > 1 for n in met.values())
