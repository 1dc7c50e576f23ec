"""What op7 sends through shuffles: packed, and the same once unpacked."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from boxwood.llm import lm_scoring as L


def test_messages_and_numbers_come_back():
    x = np.random.default_rng(1).random((3, 50)).astype(np.float32)
    for y in (x, x[:, :0], x[0]):
        assert (L.joined(L.unpacked(L.packed(L.planes(y)))) == y).all() and L.joined(L.planes(y)).shape == y.shape
    assert L.unpacked(L.packed([b"", b"a\0"])) == [b"", b"a\0"]


def test_texts_cross_the_shuffle_packed(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 8))) for _ in range(800)]
    rows = [(i, None if i == 3 else " ".join(rng.choices(words, k=300))) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, text string").coalesce(2)
    docs = df.select("id", (F.col("id") % 5 == 1).alias("held_out"), F.col("text").cast("binary").alias("data"), F.spark_partition_id().alias("block"))
    got = L.packed_texts(docs, "bigint").collect()
    assert sorted((i, t, h) for r in got for i, t, h in zip(r["ids"], L.unpacked(r["data"]), r["held_out"], strict=True)) == [(i, (t or "").encode(), i % 5 == 1) for i, t in rows]
    plain = b"".join((t or "").encode() for _, t in rows)
    assert 10 * sum(len(r["data"]) for r in got) < 7 * len(pa.compress(plain, codec="lz4", asbytes=True))
