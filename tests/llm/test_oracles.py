import duckdb
import pytest

from trawl.llm.oracles import ORACLE_SQL
from trawl.llm.queries import QUERIES


def both(spark, folder, name):
    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "embeddings"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'/*.parquet' if folder.startswith('/tmp') else ''}')")
    got = QUERIES[name](spark, folder)
    sql = db.execute(ORACLE_SQL[name])
    assert got.columns == [d[0] for d in sql.description]
    return sorted(map(tuple, got.collect()), key=str), sorted(sql.fetchall(), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_whole_tables(spark, sf, name):
    got, expected = both(spark, sf, name)
    assert got == expected and got


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Small tables of odd rows: nulls, repeated rows, rings of links, a bad host."""
    folder = str(tmp_path_factory.mktemp("odd"))
    good = "many different words stand here one after the other without end and number "
    docs = [(100 * h + i, good + str(i) if i % 12 else "short", "en", f"src{h}") for h in range(20) for i in range(50)]
    docs = [(i, "too short" if s == "src7" and i % 5 < 3 else t, lang, s) for i, t, lang, s in docs]
    docs += [(None, None, None, None), (5, " \n\t", "en", None), (5, " \n\t", "en", None), (6, "é # | x\nx\nx y\n\nx y\x0bz", "fr", "src1"), (7, "a b c d e f " * 30, "en", "src2"), (8, "A  B\nC", "en", "s"), (9, "ABC", "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    pages = [(k, f"http://a.net/{'de' if k < 5 else 'fr'}/{k}", "<a href='http://b.NET/'>") for k in range(50)]
    pages += [(100 + k, f"http://b.net/{'de' if k < 3 else 'fr'}/{k}", "<a data-href='//no.org/' href=//a.net/x>") for k in range(50)]
    pages += [(None, None, None), (1, "no scheme", ""), (2, "http://Example.COM/en/71?x", "<b>"), (2, "http://Example.COM/en/71?x", "<b>"), (3, "x\n://a.example.com/en/8#y", "<A\nHREF = \"https://example.com/\">")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(1, t, ["system", "user", "user", "assistant", "assistant", "user", "assistant"][t], f'say "{t}"\n\\ é /') for t in range(7)]
    turns += [(1, 3, "assistant", "again"), (None, 1, "user", None), (None, 2, "assistant", ""), (2, 5, None, "t"), (2, 9, "user", "\u2028 \x7f \t"), (2, 9, "user", "\u2028 \x7f \t")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    near = [(k, [1.0, 0.01 * k, (k % 5) * 0.3], k % 3) for k in range(120)]
    near += [(50, [0.5, 0.5, 0.5], 2), (7, None, 1), (None, [1.0, 0.0, 0.9], 1), (200, [1.0, None, 0.0], 0), (250, [1.0], 0), (251, [0.5], 0), (252, [0.4], 1)]
    spark.createDataFrame(near, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_odd_tables(spark, odd, name):
    got, expected = both(spark, odd, name)
    assert got == expected
    if name == "op10_quality":
        rejected = {r[0] // 100 for r in got if r[8] and r[0] is not None}
        assert rejected == {7} and all(not r[7] for r in got if r[0] is not None and r[0] // 100 == 7)
    if name == "op8_url_graph":
        assert {r[4] for r in got if r[1] in ("a.net", "b.net")} == {"block"}
