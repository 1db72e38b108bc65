"""Odd rows and ties on which registered queries have to equal their SQL."""

import duckdb
import pytest

from lodestar.operators import textsearch
from lodestar.queries import ORACLES, QUERIES
from lodestar.sources import files as sources
from tests.test_oracles import rows


def same_as_sql(spark, folder, names, **tables):
    for name, (data, ddl) in tables.items():
        spark.createDataFrame(data, ddl).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    for name in tables:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    for name in names:
        got, want = QUERIES[name](spark, str(folder)), con.sql(ORACLES[name])
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall()), name


@pytest.mark.parametrize("name", ["embedding_export", "vector_text"])
def test_ties_of_number_formats(spark, tmp_path, name):
    """9 / 128 is a tie at six decimals; C's formats take the even digit."""
    odd = [9 / 128, -9 / 128, 11 / 128, 0.5, float("nan"), float("inf"), 3.0e20, -0.0]
    data = [(1, odd * 8, 0), (2, [j / 8192 for j in range(64)], 1), (3, [1 / 3] * 63 + [1 / 8192], 1)]
    same_as_sql(spark, tmp_path, [name], embeddings=(data, "vec_id long, embedding array<float>, label int"))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sentences_of_blank_texts(spark, tmp_path):
    texts = ["", " \n ", None, "One. Two!  three", "...", "\u3000", "a.\u3000b"]
    data = [(i, t, "en", "src0", 0) for i, t in enumerate(texts)]
    same_as_sql(spark, tmp_path, ["sentence_split"], documents=(data, DOCUMENTS))


STORE_DOCUMENTS = [(1, "", "de", "src0", 0), (2, " \n", "en", "src1", 2), (3, "\t", "de", "src0", 1), (4, "One two two.", "en", "src2", 12), (5, "zwei", "de", "src0", 4), (6, " ", "fr", "src0", 1), (9, "nine", "fr", "src1", 4)]


@pytest.mark.parametrize("name", ["store_counts", "store_delete_files", "store_delete", "store_upsert", "store_postings"])
def test_store_queries_with_blank_texts(spark, tmp_path, name):
    """The SQL of store_upsert leaves blank documents out, that of the others counts them."""
    vectors = [(i, [float(i)] * 64, 0) for i in (1, 2, 3, 4, 6, 70)]
    same_as_sql(spark, tmp_path, [name], documents=(STORE_DOCUMENTS, DOCUMENTS), embeddings=(vectors, "vec_id long, embedding array<float>, label int"))


def test_postings_of_repeated_ids(spark, tmp_path):
    """Rows of one id are one chunk of the postings; texts without terms and null have none."""
    data = [(1, "a b a", "en", "s", 0), (1, "a c", "en", "s", 0), (1, "a c", "en", "s", 0), (2, None, "en", "s", 0), (3, "...", "en", "s", 0), (None, "a", "en", "s", 0)]
    same_as_sql(spark, tmp_path, ["postings_terms"], documents=(data, DOCUMENTS))


def test_postings_are_made_within_rows(spark, monkeypatch):
    """No token is a row that is shuffled or sorted; slices of a batch give the whole postings."""
    texts = [(f"c{i}", " ".join(f"t{(i * j) % 7}" for j in range(i))) for i in range(40)]
    monkeypatch.setattr(textsearch, "TOKENS_AT_ONCE", 50)
    index = textsearch.build(spark.createDataFrame(texts, "chunk_id string, text string"), unique=True)
    plan = index.postings._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan and "Sort" not in plan
    want = {(t, c, len(x.split()), tuple(i for i, w in enumerate(x.split()) if w == t)) for c, x in texts for t in x.split()}
    got = index.postings.select("term", "chunk_id", "dl", "tf", "positions").collect()
    assert {(r.term, r.chunk_id, r.dl, tuple(r.positions)) for r in got} == want and len(got) == len(want) and all(r.tf == len(r.positions) for r in got)


def test_rows_of_many_files_go_out_together(spark, monkeypatch):
    """Blocks of files in small and in large groups are the same; a frame for each file was made before."""
    files = spark.createDataFrame([(f"in/{i}.txt", bytearray(f"a{i}\n\nb{i}\n\n\nc".encode() * (i % 3))) for i in range(30)] + [("x.bin", bytearray(b"\0"))], "path string, content binary")
    read = lambda: sorted(map(str, sources.read_blocks(files).collect()))
    whole = read()
    monkeypatch.setattr(sources, "ROWS_AT_ONCE", 7)
    assert read() == whole and len(whole) == 10 * (1 + 3 + 5) + 1
    groups = [b.num_rows for b in sources.read_blocks(files.coalesce(1)).toArrow().to_batches()]
    assert sum(groups) == len(whole)
