import pytest

import __spark_entry__ as entry
from tandem.plans import catalog
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


def test_accepted_matches_against_a_loop(spark):
    events = sorted((r.user_id, r.event_id) for r in spark.read.parquet(f"{SF}/events.parquet").collect())
    want, used = [], {}
    for user, e in events:
        i, j = e % 23, e % 19
        rows, columns = used.setdefault(user, (set(), set()))
        if i < 20 and j < 20 and i not in rows and j not in columns:
            rows.add(i), columns.add(j)
            want.append((str(user), i, j))
    assert sorted((r.run_id, r.i, r.j) for r in catalog.QUERIES["accepted_matches"](spark, SF).collect()) == sorted(want)


def test_nearest_pairs_against_a_loop(spark):
    orders = {}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").orderBy("l_orderkey", "l_linenumber", "l_quantity").collect():
        orders.setdefault(r.l_orderkey, []).append((r.l_linenumber, r.l_quantity))
    want = []
    for key, xs in orders.items():
        a, rest, n = [q for line, q in xs if line % 2], [q for line, q in xs if line % 2 == 0], 0
        for x in a:
            want.append((key, n, x, rest.pop(min(range(len(rest)), key=lambda i: (abs(x - rest[i]), i))) if rest else None))
            n += 1
        want += [(key, n + k, None, y) for k, y in enumerate(rest)]
    got = [(r.l_orderkey, r.pos, r.a, r.b) for r in catalog.QUERIES["nearest_pairs"](spark, SF).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_layout_sentences_hold_the_text(spark):
    """Laid out and joined again, every document has the letters of its lines that are no headings, page numbers or running headers."""
    made = {}
    for r in catalog.QUERIES["layout_sentences"](spark, SF).collect():
        made.setdefault(r.run_id, []).append((int(r.sid.rpartition("s")[2]), r.text))
    texts = {str(r.doc_id): r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(made) > 150
    for run, rows in made.items():
        assert [n for n, _ in sorted(rows)] == list(range(1, len(rows) + 1))
        bare = "".join(texts[run].split())
        assert all("".join(t.split()) in bare for _, t in rows)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
