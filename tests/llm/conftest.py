import pytest

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
TEXTS = [
    (0, "The quick brown fox jumps over the lazy dog and runs far away from here, over hills and fields and rivers, to a quiet old town by the sea.", "en"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here, over hills and fields and rivers, to a quiet old town by the sea.", "en"),
    (2, None, "en"),
    (3, "", None),
    (4, "  \n \n\t  ", "de"),
    (5, "a@b.com_x@y.zz 1.2.3.4.5.6.7.8 300.1.2.3 x 4111 1111 1111 1111 y +1 (017) 555-7713 z 007.08.9.10", "en"),
    (6, "<|endoftext|>mid<|endoftext|> 's don't  two   three \n x", "fr"),
    (7, "ein zwei drei vier funf sechs sieben acht " * 6 + "\nein\nein\n# $ % |", "de"),
    (8, LONG, "en"),
    (8, LONG, "en"),
    (None, "no id here", "en"),
    (9, "1" * 3_000 + " " + "x" * 3_000 + "@", "en"),
    (10, "café 世界 \U0001f600   \x1f \x85 \U0001246f", "en"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(*t, "clash", 1, "x") for t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h string, kept int, ids string").coalesce(2)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
