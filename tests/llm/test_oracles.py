"""The corpus queries on the smallest tables: against their SQL, or what the pages were made from."""

import html
import os
import re
from collections import Counter

import pytest

from cuelight.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    plain = lambda x: float(f"{x:.12g}") if isinstance(x, float) else x
    want = Counter(tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert Counter(tuple(plain(r[c]) for c in cols) for r in df.collect()) == want


def test_pages_give_their_articles(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in queries.op1_html_main_text(spark, SF).collect()}
    assert len(got) == len(pages)
    for p in pages:
        body = p.html[p.html.index("<article>") + 9 : p.html.index("</article>")]
        blocks = (html.unescape(re.sub("<[^>]*>", " ", b)) for b in re.split("</?(?:h1|p)[^>]*>", body))
        assert got[p.page_id] == "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)
