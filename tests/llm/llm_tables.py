"""Small inputs and plain helpers for the tests of this folder."""

import duckdb
from tokenizers import Tokenizer

from stayspark.llm.queries import word_bpe

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations".split()


def load(sql, folder=FOLDER):
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return db.execute(sql).fetchall()


def documents(spark, rows):
    """``(doc_id, text)`` rows with the other columns of documents, and names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, start string, key string"
    full = [(k, t, None, "s", len(t or ""), "clash", "clash") for k, t in rows]
    return spark.createDataFrame(full, schema)


def plain_encoder():
    tokenizer = Tokenizer.from_file(word_bpe())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
