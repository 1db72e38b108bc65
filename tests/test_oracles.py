import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar import library_queries  # noqa: F401
from lodestar import queries
from lodestar.functions import scalars
from lodestar.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    return repr(round(value, 6) + 0.0) if isinstance(value, float) else str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, duck, sf_dir, name):
    got, want = QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, sf_dir):
    assert "TakeOrderedAndProject" in plan(QUERIES["knn_cosine_topk"](spark, sf_dir))
    assert "BroadcastHashJoin" in plan(QUERIES["hydrate_hits"](spark, sf_dir))
    filtered = plan(QUERIES["filter_doc_eq"](spark, sf_dir))
    assert "PushedFilters" in filtered and "value#" not in filtered.split("ReadSchema")[-1]


def test_entry_points(spark):
    import __spark_entry__

    assert set(ORACLES) <= set(__spark_entry__.oracle_sql()) and set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["chunk_id", "score"]


def test_hash_embedding_takes_whole_texts(spark, tmp_path):
    """Texts that agree in their first 8,192 characters have vectors of their own."""
    same = "x" * 8192
    spark.createDataFrame([(1, same + "a"), (2, same + "b"), (3, "short")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    vectors = {r.doc_id: tuple(r.vec) for r in QUERIES["hash_embedding"](spark, str(tmp_path)).collect()}
    assert len(set(vectors.values())) == 3 and all(len(v) == 16 for v in vectors.values())


def test_escape_json_takes_whole_texts(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", scalars.escape_json(F.col("text")).alias("json"))
    assert all(r.json == r.text.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") for r in d.collect())


def test_sorted_files_keep_their_order(spark, duck, sf_dir):
    places = [r.doc_id for r in queries.sequence.sort_files(queries._files(spark, sf_dir), "pages", descending=True).collect()]
    assert places == [r[0] for r in duck.sql(ORACLES["files_sorted_by_key"] + " ORDER BY place").fetchall()]
