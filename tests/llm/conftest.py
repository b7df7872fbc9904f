import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, __text string, id long"


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["la", "re", "tion", "é", "que", "an"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60)) + "."
    out = []
    for i in range(60):
        text = "\n".join(" ".join(word() for _ in range(rng.randint(3, 30))) + "." for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            text = text + " " + passage
        if i % 11 == 0:
            text = out[-1][1] if out else text
        out.append((i, text, "en" if i % 2 else "fr", f"s{i % 4}" if i % 9 else None))
    out += [(60, None, "en", "s1"), (61, "", None, "s1"), (62, " \n\t ", "en", "s2"), (63, "###", None, None), (64, "x" * 70000, "en", "s2"), (65, (passage + " ") * 300, "fr", "s0"),
            (66, "Ünï 漢字 😀 cödé", "fr", "s3"), (5, out[5][1], "en", "s1"), (5, out[5][1], "en", "s1"), (None, out[7][1], "en", "s0")]
    return [(*r, len(r[1] or ""), 0.5, "clash", 7) for r in out]


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, repeated rows and columns whose names clash with results."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def plain(spark, documents):
    """The same without null or repeated ids."""
    return documents.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).cache()


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
