from pyspark.sql import functions as F

from corpusmill.functions import hashing as H


def test_blake3_vectors():
    assert H.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert H.blake3(b"abc").hex() == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"
    # The published vectors repeat bytes 0 to 250.
    data = bytes(i % 251 for i in range(2049))
    assert H.blake3(data[:1024]).hex().startswith("42214739f095a406")
    assert H.blake3(data[:1025]).hex().startswith("d00278ae47eb27b3")
    assert H.blake3(data[:2049]).hex().startswith("5f4d72f40d7a5f82")


def test_text_forms():
    assert H.base32_text(b"foobar") == "mzxw6ytboi" and H.base32_bytes("mzxw6ytboi") == b"foobar"
    assert H.crc32c(b"123456789") == 0xE3069283
    assert len(H.note_name(b"x")) == 26


def test_columns(spark):
    good = H.note_name(b"body")
    df = spark.createDataFrame([(good, "body"), (good, "other"), ("short", "body"), (None, None)], "name string, body string")
    rows = df.select(H.name_holds(F.col("name"), F.col("body")).alias("ok"), H.nfkc_column(F.lit("ﬁ")).alias("n"), H.crc32c_column(F.col("body")).alias("c"), H.blake3_column(F.col("body")).alias("b")).collect()
    assert [r.ok for r in rows] == [True, False, None, None] and rows[0].n == "fi" and rows[3].c is None and rows[0].b == H.blake3(b"body").hex()
