from __future__ import annotations

import ast
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lexmill import queries as core
from tests.compare import DATA, same

SQL = core.oracle_sql()
SMALL = DATA / "sf0.001"
needs_data = pytest.mark.skipif(not SMALL.exists(), reason="the test tables are not here")


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    same(spark, core.queries()[name], SQL[name], SMALL)


def _tokens(spark):
    t = spark.read.parquet(f"{SMALL}/api_expansions.parquet").where("qid IS NOT NULL").selectExpr("qid", "explode(associated_terms) v").selectExpr("qid", "explode(split(trim(v), ' ')) token")
    return t.where("token <> ''").distinct().count()


#: What holds of the rows of the queries that SQL can't express.
CONTENT = {
    "kmeans_clusters": lambda spark, rows: sum(r["n"] for r in rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and len({r["cluster"] for r in rows}) == 10,
    "pca_projection": lambda spark, rows: len(rows) == spark.read.parquet(f"{SMALL}/embeddings.parquet").count() and sum(r["x"] ** 2 for r in rows) >= sum(r["y"] ** 2 for r in rows) * 0.5,
    "token_clusters": lambda spark, rows: len(rows) == _tokens(spark) and all(r["token"].lstrip("#").lower().startswith(r["stem"]) and r["score"] <= r["max_score"] for r in rows),
    "word2vec": lambda spark, rows: rows and {len(r["vector"]) for r in rows} == {200} and len({r["word"] for r in rows}) == len(rows),
    "tree_cosine": lambda spark, rows: {r["depth"] for r in rows} <= {0, 1, 2, 3} and all(r["cos"] is None or -1.0001 <= r["cos"] <= 1.0001 for r in rows) and all(r["path"].startswith("heat") for r in rows),
    "cosine_by_depth": lambda spark, rows: all(r["q10"] <= r["q25"] <= r["q50"] <= r["q75"] <= r["q90"] for r in rows) and len({r["depth"] for r in rows}) == len(rows),
    "next_word_change": lambda spark, rows: len(rows) <= 10 and all(0 < r["p"] <= 1 and (r["change"] is None or abs(r["change"]) <= 2) for r in rows),
}


@needs_data
@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_without_sql(spark, name):
    assert CONTENT[name](spark, core.queries()[name](spark, str(SMALL)).collect())


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["qid", "doc_id", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_imports_the_optional_subpackage():
    root = Path(core.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" in f.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(f.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("lexmill.llm") for n in names), f
