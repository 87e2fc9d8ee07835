"""The five stages on awkward rows, with columns that clash, and on an empty table."""

import edge
import pytest

import corpus_pipeline
from cellgrid.session import durable

CLASHES = "i int, t string, _limits int, Kept int, Language string, Signals int, `a.b` int, row int, first int"


def through(spark, docs):
    """Columns and rows after every stage."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, ""))
        out.append((name, docs.columns, docs.collect()))
    return out


@pytest.fixture(scope="module")
def clashing(spark):
    plain = "doc_id long, text string, lang string, source string, n_chars long, "
    rows = [(*r[:5], 1, "t", 2, 3, "x", 4, 5, 6, 7) for r in edge.rows()]
    return spark.createDataFrame(rows, plain + CLASHES).repartition(3)


def test_awkward_rows_and_clashing_columns(spark, clashing):
    (_, good, kept), (_, spoken, told), (_, single, alone), (_, cut, stripped), (_, _, packed) = through(spark, clashing)
    assert good == spoken == single == cut == clashing.columns
    # nulls, empty and short texts and repeated lines go; prose stays
    assert not {1, 2, 3, 4, 10, 11} & {r.doc_id for r in kept} and {5, 6, 7, 8, 12} <= {r.doc_id for r in kept}
    assert {r.doc_id for r in told} <= {r.doc_id for r in kept}
    # 5, 6 and 7 are copies, as are the rows 13 and the one without an id
    ids = [r.doc_id for r in alone]
    assert ids.count(5) == 1 and not {6, 7} & set(ids) and ids.count(13) + ids.count(None) == 1
    # 8 holds the first 700 characters of 5: gone from both
    texts = {r.doc_id: r for r in stripped}
    assert edge.prose(300, 1)[:600] not in texts[5].text and edge.prose(300, 1)[:600] not in texts[8].text
    assert all(r.n_chars == len(r.text) and r["a.b"] == 5 and r.t == "t" for r in stripped)
    by_doc = {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    assert all(r.offset + r.length <= 2048 for r in packed)


def test_empty_table(spark, clashing):
    assert all(not rows for _, _, rows in through(spark, clashing.limit(0)))
