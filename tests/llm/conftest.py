import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, bucket string, key string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards mix potent brews near cold northern lakes at dawn".split()


def prose(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * (seed % 5 + 1) + i) % len(WORDS)] + ("," if i % 9 == 4 else "") for i in range(n))


def odd_rows():
    long = prose(3, 9000)
    rows = [(i, prose(i, 40 + i % 30), "en" if i % 2 else "de", f"s{i % 3}") for i in range(12)]
    rows += [
        (100, None, "en", "s0"), (101, "", "en", "s0"), (102, " \t\n ", None, "s1"), (103, "1 2 3 !!", "de", None), (104, long, "en", "s1"), (105, long + " tail", "en", "s1"),
        (106, prose(5, 45), "en", "s2"), (107, prose(5, 45), None, None), (108, "Mail a.b@c.example.org or +1 (239) 555-8522; card 4539578763621486 and 10.0.0.255 é ß 日本", "en", "s2"),
        (109, "x", "en", "s2"), (109, "x", "en", "s2"), (None, "no id here at all", "de", "s1"), (None, None, None, None),
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, 7, "clash", None) for i, t, lang, s in rows]


@pytest.fixture(scope="session")
def odd_dir(spark, tmp_path_factory):
    """A folder of tables with nulls, empty, long and repeated rows, and clashing extra columns."""
    root = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(odd_rows(), SCHEMA).coalesce(2).write.parquet(f"{root}/documents.parquet")
    page = "<html><body class='x'><nav><a href=a>Menu</a></nav><article><h1>T &amp; U</h1><p>One two</p></article><footer>f</footer></body></html>"
    pages = [(1, "http://a.example/x", page, "e"), (2, None, page, "e"), (3, "http://a.example/y", None, None), (4, "odd", "", None), (5, "http://a.example/z", "<<<>& no tags <p", "e"), (1, "http://a.example/x", page, "e"), (None, "http://b.example", "<p>" * 3000 + "deep", "e")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{root}/pages.parquet")
    return str(root)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{root}/documents.parquet")
    others = {"pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int", "conversations": "conv_id long, turn long, role string, text string"}
    for table, schema in others.items():
        spark.createDataFrame([], schema).write.parquet(f"{root}/{table}.parquet")
    return str(root)


@pytest.fixture(scope="session")
def docs(odd_dir, spark):
    """Rows of the odd table with ids, as (id, text or empty) in ascending order."""
    rows = spark.read.parquet(f"{odd_dir}/documents.parquet").where(F.col("doc_id").isNotNull()).select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    return sorted((r["doc_id"], r["t"]) for r in rows)
