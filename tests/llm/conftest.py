from __future__ import annotations

import random
import sys
from pathlib import Path

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

sys.path.insert(0, str(Path(__file__).resolve().parent))

SF_DIR = "/root/testdata/sf0.001"


def invented(seed: int, n: int) -> str:
    draw = random.Random(seed)
    parts = ["an", "re", "ti", "on", "el", "su", "ka", "mor", "vi", "dé"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Nulls, empty and long texts, ties, repeated rows, copies near and exact, shared passages."""
    base, passage = invented(1, 120), invented(2, 60)
    edited = base.split()
    edited[60] = "edited"
    texts = [
        (1, base), (2, base), (3, " ".join(edited)), (4, base + " tail word"), (5, None), (6, ""), (7, " \t\n "),
        (8, "one two"), (9, "ONE two"), (9, "ONE two"), (10, invented(3, 100) + "\n" + passage + "\n" + invented(4, 80)),
        (11, invented(5, 90) + " " + passage), (11, invented(6, 70)), (None, base), (None, invented(7, 55)), (None, None),
        (12, "x" * 5000), (13, "ab" * 300), (14, invented(8, 3000)), (15, "x" * 5000 + " y"), (16, (invented(9, 40) + "\n") * 6),
        (17, "é" * 60 + " ñandú " + invented(10, 52)), (18, "aaaa " * 80), (19, "WORD!! " * 30 + invented(11, 60)),
        (20, invented(12, 60) + " 1d10t s t u p i d m0r0n"), (21, invented(13, 70) + " a#b|c $%& " * 9), (22, "▁ mark ▁▁ x"),
    ]
    return texts + [(100 + i, passage + " " + invented(100 + i, 5 + i)) for i in range(12)]


#: Names that the operators use inside, and a null in each.
CLASHING = ("g", "bucket", "row", "id", "keys", "name", "size", "block", "segment", "tokens", "kept", "score", "ids", "n_tokens", "records", "word")


@pytest.fixture(scope="session")
def rows():
    return documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = [StructField(c, StringType()) for c in CLASHING]
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), *extra])
    data = [(i, t, "en" if k % 3 else None, *(f"{c}{k}" if k % 2 else None for c in CLASHING)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(data, schema)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
