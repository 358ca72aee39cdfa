import pytest

from quire.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, same_rows, name):
    same_rows(spark, duck, catalog.queries()[name], catalog.oracle_sql()[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_page_split_keeps_all_html(spark):
    from conftest import DATA

    rows = catalog.queries()["page_article_split"](spark, DATA).collect()
    assert len(rows) == 50 and all(r.number == 1 and r.html.startswith("<h1>") and r.title for r in rows)


def test_all_articles_of_a_page_count(spark):
    from quire.sources.adapters import page_articles

    made = [(1, "<p>x</p><article class=a><h1>A</h1></article>y<article>\n<h1>B</h1></article>"), (2, "<p>none</p>"), (3, None)]
    got = page_articles(spark.createDataFrame(made, "page_id int, html string")).collect()
    assert [tuple(r) for r in got] == [(1, "<h1>A</h1>\n<h1>B</h1>"), (2, "<p>none</p>"), (3, None)]


def test_plans_push_down_and_shuffle_once(spark):
    from conftest import DATA
    from quire.operators.split import split_blocks
    from quire.sources.adapters import conversation_blocks, load

    df = split_blocks(conversation_blocks(load(spark, DATA, "conversations")), 1)
    plan = df.filter("doc_id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(conv_id), EqualTo(conv_id,3)]" in plan
    assert plan.count("Exchange hashpartitioning") == 1
