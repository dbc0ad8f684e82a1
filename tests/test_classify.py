"""The types of messages against the SQL, on texts that the test tables do not hold."""

import duckdb
from sparkloom.plans import texts

TEXTS = [
    "Éab éa éb éc éd ée éf", "Éé éabé éé éé éé éé éé", "Àb Çd Éf Ôh Âj Ûl", "é é é é é é Éab", "é é é é é é ÉAb\x85", "é é é é é é:12 ", "é é é é é é Ab\n",
    "é\x0bé\x0bé\x0bé\x0bé\x0bé\x0bé", "é é é é é é", "create\x0bé é é é é é", "", " ", "ça Été",
]


def test_classify_text(spark, tmp_path):
    rows = spark.createDataFrame([(i, 0, x) for i, x in enumerate(TEXTS)], "conv_id long, turn int, text string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in texts.classify_text(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(db.execute(texts.SQL["classify_text"]).fetchall())
