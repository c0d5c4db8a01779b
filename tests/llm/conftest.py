"""Small texts with all the awkward cases."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgéß日") for _ in range(rng.randint(1, 7))) for _ in range(60)]

    def some(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(n))

    long = [some(120) for _ in range(4)]
    lines = [some(6) for _ in range(6)]
    near = [" ".join(w if i != k * 9 else "zz" for i, w in enumerate(long[0].split())) for k in range(1, 5)]
    return [
        None, "", " \n\t ", "x", "a b c d", long[0], long[0], *near, *long[1:], "\n".join(lines), "head\n" + "\n".join(lines[1:5]) + "\ntail", "\n".join(["same"] * 7), "\n\n\n\n", some(3000), "y" * 5000,
        "Released under the MIT License. GNU General Public License, version 3 cc by cc by", "two  spaces   three ▁ x\x00y <s>", "AB! CD!! " * 40, "  lead and trail  ", "İ É Kelvin K",
    ]


@pytest.fixture(scope="session")
def rows():
    return [(i * 3 if i != 4 else None, t, None if i % 5 == 0 else "en", f"src{i % 2}", None if t is None else len(t)) for i, t in enumerate(texts())]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def clash(spark, rows):
    """The same rows with columns named as the operators' own."""
    return spark.createDataFrame([(*r, 1, "z", [1]) for r in rows], SCHEMA + ", pos int, lines string, row array<int>").cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}
