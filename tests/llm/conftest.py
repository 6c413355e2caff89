import random

import pyarrow as pa
import pytest

WORDS = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return "".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(n))


def make_documents():
    """Rows that meet the odd cases: nulls, empty, copies, near copies, shared passages, a very long text, junk."""
    rng = random.Random(7)
    texts = [prose(rng, rng.randint(1, 300)) for _ in range(60)]
    passage = prose(rng, 80).strip()
    texts += [None, "", " \n ", "a", "é ü", "A.b-C", texts[0], texts[0], texts[3]]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 30)}" for _ in range(6)]
    near = texts[5].split(" ")
    for k in range(5):
        copy = list(near)
        copy[min(len(copy) - 1, 3 + k)] = "changed"
        texts.append(" ".join(copy))
    texts += [prose(rng, 6000), "x" * 900, "ab " * 400, ("line one two three\n" * 40), "### $$$ %%% " * 60]
    sources = [None if k % 17 == 0 else "src0" if k % 3 else f"src{k % 5}" for k in range(len(texts))]
    return [{"doc_id": 3 * k + 1, "text": t, "lang": None if k % 13 == 0 else "en", "source": s, "n_chars": len(t or "")} for k, (t, s) in enumerate(zip(texts, sources, strict=True))]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    kinds = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=kinds)).repartition(5)


@pytest.fixture(scope="session")
def stored(spark, documents, tmp_path_factory):
    """The documents as a Parquet table of several files, with a column whose name an operator might use."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    documents.withColumnsRenamed({}).selectExpr("*", "n_chars AS n_words").write.parquet(path)
    return spark.read.parquet(path)
