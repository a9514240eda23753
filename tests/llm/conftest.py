import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, fp long, line_no int, d1 long, h long, ids string, predicted int, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(rng: random.Random, sentences: int) -> str:
    return " ".join(" ".join(rng.choices(WORDS, k=rng.randint(4, 14))).capitalize() + "." for _ in range(sentences))


def messy_rows() -> list[tuple]:
    """Texts with copies, near copies, shared passages, blanks, nulls, long ones and repeated rows."""
    rng = random.Random(5)
    shared, base = prose(rng, 12), [prose(rng, 3) + "\n" + prose(rng, 2) for _ in range(12)]
    texts = [
        *base, base[0], base[1], base[2].replace("alpha", "alphq", 1), base[3][:-1] + "!", base[4] + "\n" + shared, shared + "\n" + base[5], "x " + shared + " y",
        None, "", " \n\t\n ", "short", "\n".join(["same line of words again and again"] * 5), "Ünïcode – naïve façade 漢字 🙂 " * 9, "a" * 5000, ("ab" * 3000) + "\n" + ("ab" * 3000), " ".join(prose(rng, 4) for _ in range(60)),
        "<|endoftext|> and <|endoftext|>", "tabs\tand\r\nreturns  and   spaces ", "don't we'll I'M 123456 !!! ?? nbsp",
    ]
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (None, base[0], "en", "src0", 5), (None, None, None, None, None), (-3, base[6], "de", "src1", 7)]
    return [(*r, 0.5, "k", 7, 3, 1, 2, "i", 9, "z") for r in rows]


@pytest.fixture(scope="session")
def messy(spark):
    return spark.createDataFrame(messy_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def fixture_dir(spark, messy, tmp_path_factory):
    """A folder of small tables for whole queries."""
    path = str(tmp_path_factory.mktemp("tables"))
    messy.write.parquet(f"{path}/documents.parquet")
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(12)] + [(None, 1, 1), (3, 1, None), (999, 0, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    texts = [r.text for r in messy.where("doc_id < 3").orderBy("doc_id").collect()]
    spark.createDataFrame([(0, texts[0]), (1, "nothing of it stands anywhere in these documents at all"), (2, "漢字 façade"), (3, None), (None, texts[1])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path
