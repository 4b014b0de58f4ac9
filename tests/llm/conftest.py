import random

import pytest

EXTRA = ["shard", "slot", "_id", "_th", "n_words", "copies", "kept", "size", "target"]


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]

    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    rows = [(0, None, "en", "a"), (1, "", "en", "b"), (2, " \n\t ", None, None), (3, "One two", "en", "a")]
    base, shared = words(300), words(70)
    for i in range(4, 40):
        rows.append((i, " ".join(words(rng.randint(5, 200))), "en", rng.choice("abc")))
    for i in range(40, 46):
        rows.append((i, " ".join(base), "de", "a"))  # exact copies
    for i in range(46, 52):
        near = list(base)
        near[rng.randrange(300)] = "changed"
        rows.append((i, " ".join(near), "de", "b"))
    for i in range(52, 64):
        rows.append((i, " ".join(words(20) + shared + words(20)).replace(shared[10], shared[10] + "\n", 1), "fr", None))
    rows.append((64, " ".join(words(6000)), "en", "c"))  # long
    rows += [(3, "One two", "en", "a"), (3, "another text", "en", "a"), (None, " ".join(base), None, "a"), (None, None, None, None)]
    rows.append((65, "ab" * 400, "en", "b"))
    rows.append((66, "The line\nshared\nThe line\n  SHARED \n" + "x\n" * 5, "en", "b"))
    rows += [(67 + i, f"shared\nown {i}", "en", "b") for i in range(12)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id bigint, text string, lang string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(docs):
    """The same rows with further columns whose names the operators use as well."""
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit("x").alias(name) for name in EXTRA])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string")


@pytest.fixture(scope="session")
def corpus_dir(docs, tmp_path_factory):
    """A folder with the rows as ``documents``, as the queries read it."""
    folder = tmp_path_factory.mktemp("corpus")
    docs.write.parquet(f"{folder}/documents.parquet")
    return str(folder)
