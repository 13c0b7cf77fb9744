import pytest
from llm_texts import TEXTS


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", None if t is None else len(t), -1.0, "clash", i) for i, t in enumerate(TEXTS)]
    rows.append(rows[0])  # a repeated row
    rows.append((None, "a row without an id", None, None, None, 0.0, "clash", 0))
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, fp long"
    return spark.createDataFrame(rows, schema).repartition(3, "n_chars")


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
