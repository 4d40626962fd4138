import random

import pytest

CLASHING = ["row", "words", "n_words", "kept", "key", "node", "anchor", "spans", "others", "bits", "severity", "kept_row"]
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_texts():
    """Nulls, empty, blank, one-word, very long, repeated and marked texts."""
    rng = random.Random(11)
    words = ["alpha", "beta", "don't", "Été", "naïve", "x1", "2024", "–", "漢字", "the", "of"]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    prose = " ".join(rng.choice(words) for _ in range(120))
    return [
        (1, prose),
        (2, prose),
        (2, prose),
        (2, "another text under the same id"),
        (None, "no id at all"),
        (None, None),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one"),
        (7, long),
        (8, "a" * 5000),
        (9, "<|endoftext|> [INST] </s> ▁ <s>\n\n\nRuns   of space   end "),
        (10, "it's we'll 'x '' 'S \U0001d11é 𐍈"),
    ]


@pytest.fixture
def stored(spark, folder):
    """Write rows as a table in a folder of tables; returns the folder."""

    def write(name, rows, schema, files=2):
        df = spark.createDataFrame(rows, schema)
        df.repartition(files).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
        return folder

    return write


@pytest.fixture
def awkward(spark, stored):
    """The awkward texts as documents, with columns of the names operators use themselves."""
    extra = ", ".join(f"`{c}` string" for c in CLASHING)
    rows = [(i, t, None, "s", None, *["!"] * len(CLASHING)) for i, t in awkward_texts()]
    folder = stored("documents", rows, f"{DOCUMENTS}, {extra}")
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture
def nothing(spark, stored):
    folder = stored("nothing", [], DOCUMENTS)
    return spark.read.schema(DOCUMENTS).parquet(f"{folder}/nothing.parquet")
