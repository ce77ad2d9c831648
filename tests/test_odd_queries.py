"""Queries against their SQL on small tables that hold what the driver's smallest tables lack."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from brookloom.plans.queries import oracle_sql, queries
from brookloom.sources.html import html_nodes


def same(spark, at, name):
    con = duckdb.connect()
    for f in at.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}/*.parquet'")
    got = queries()[name](spark, str(at))
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    names = ", ".join(f'"{c}"' for c in columns)
    want = con.execute(f"SELECT {names} FROM ({oracle_sql()[name]})").fetchall()
    plain = lambda x: repr(tuple(list(v) if isinstance(v, (list, tuple)) else v for v in x))
    assert list(map(plain, rows)) == sorted(map(plain, want))
    return rows


CUT = """<!DOCTYPE html><html><head><title>{t}</title><script>var a = 1 && 2;</script></head><body><nav><a href="/x?a=1&copy=2">n</a></nav><div class="ad">Some words of an ad here.</div>
<article><h1>{t}</h1><p>{p} Both &amp; &lt;b&gt; stand, and so do &quot;these&quot; words of a paragraph that goes on. {p} {p} {p} {p}</p><p>Last words of it &am</p></article></body></html>"""


@pytest.mark.parametrize("name", ["page_blocks", "prepared_pages", "signature_roots", "page_chunks"])
def test_references_cut_short(spark, tmp_path, name):
    """Titles that end inside of a reference: what has no semicolon is text."""
    titles = ["One and two&amp", "One and two&amp;&amp;&amp", "Cut at one&lt", "Cut of one&copy", "Cut or one&midd", "Whole one&amp;", "Cut of many words of one&#38"]
    rows = [(i, f"https://a.example.com/{i}", CUT.format(t=t, p=f"{t} x.")) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert same(spark, tmp_path, name)


def test_bare_references(spark):
    page = "<body><script>a && b &amp c</script><p title='x&ampy'>one &amp two &amp; three & four &#65 five</p></body>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    text = lambda **how: [r.text for r in html_nodes(pages, **how).where(F.col("tag").isin("script", "p")).orderBy("pos").collect()]
    assert text() == ["a && b &amp c", "one & two & three & four A five"]
    assert text(bare=False) == ["a && b &amp c", "one &amp two & three & four &#65 five"]


@pytest.mark.parametrize("name", ["word_scores", "top_words"])
def test_words_with_capitals_behind_digits(spark, tmp_path, name):
    text = "9233A8ECF7C5 of 4GB and 4GB, _X or 7z; GPU Gpu gpus 12 the _x 2B2b"
    spark.createDataFrame([(1, text), (2, text * 2)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert same(spark, tmp_path, name)


def test_word_forms(spark, tmp_path):
    """Forms found document by document equal those of the general operators over rows of words, and one shuffle deals texts."""
    from brookloom.operators import terms

    texts = ["Agent agents AGENT agent Tokens token s ss S Ss, classe classes Classes", "one Two two TWO tWo Élan élans its It'S a as A", "", None, "12 34 _", "Bus buss busss Busses bus"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), F.lit(1))).alias("pos", "term"))
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "key", "term", "pos").collect()))
    assert rows(terms.word_forms(docs)) == rows(terms.one_form(words))
    assert rows(terms.word_forms(docs, plurals=True)) == rows(terms.plural_merged(terms.one_form(words)))
    odd = spark.createDataFrame([(None, "Cat cat"), (None, "x dogs CATS"), (7, "a b"), (7, "c d e"), (8, "a")], "doc_id long, text string").repartition(4)
    got = {(r.doc_id, r.key): (r.term, r.pos) for r in terms.word_forms(odd, plurals=True).collect()}
    assert got[None, "cat"] == ("Cat", 0) and got[None, "dogs"] == ("dogs", 1) and got[7, "e"] == ("e", 2) and got[8, "a"] == ("a", 0) and len(got) == 9
    for name in ("one_form_words", "plural_merged_words"):
        assert same(spark, tmp_path, name)
        plan = queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "Aggregate" not in plan


def test_look_ahead_holds_no_rows_of_pairs(spark, tmp_path):
    """Pairs of playback times and fragments are rows after the last shuffle only."""
    rows = [(c, t, None if t == 2 else f"word{t} " * (c * t % 9)) for c in range(4) for t in range(12)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert len(same(spark, tmp_path, "look_ahead")) > 1000
    plan = queries()["look_ahead"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    after = plan[: plan.index("Join")]
    assert "posexplode" in after and "row_number" not in after


def test_lines_of_odd_spaces():
    """White space of any kind between and inside of spans is one blank, and a line begins at its leftmost span."""
    from brookloom.operators.layout import group_lines

    spans = [(0, 30.0, 0.0, 40.0, 9.0, "c\x85　d "), (0, 10.0, 2.0, 25.0, 8.0, "\ta"), (0, 20.0, 2.0, 28.0, 12.0, "b"), (1, 0.0, 1.0, 5.0, 5.0, "x"), (1, 0.0, 9.0, 5.0, 12.0, "next one")]
    assert group_lines(spans) == [("a b c d", 10.0, 0.0, 40.0, 12.0, 3), ("next one", 0.0, 9.0, 5.0, 12.0, 1)]
