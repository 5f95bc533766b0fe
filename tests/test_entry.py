"""The driver's contract, and queries against SQL."""

import math
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def shown(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(shown(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", ["mwu_ref", "mwu_all_others", "mwu_external_ref", "archive_cell", "stream_arrivals", "lfc_up_down_grid", "filter_cpm_bulk", "keep_genes", "group_means_geom", "mwu_median", "bh_fdr", "special_functions", "normalize_median", "top_genes_sample", "mwu_vectors"])
def test_query_equals_sql(spark, sf_dir, sql, name):
    df = entry.queries()[name](spark, sf_dir)
    found = sql.execute(entry.oracle_sql()[name])
    assert table(df.columns, df.collect()) == table([d[0] for d in found.description], found.fetchall())


def test_every_sql_has_a_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_works_without_the_training_data_operators(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=lambda d, names: [n for n in names if n in (".git", "llm", "corpus_pipeline.py", "__pycache__")])
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(q.startswith('op') and q[2].isdigit() for q in e.queries()))"], cwd=copy, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[2] == "False" and int(done.stdout.split()[0]) > 30
