"""Page text, chat formatting and Order MinHash."""

import hashlib
import json

import edge
import pytest
from pyspark.sql import functions as F

from cellgrid.llm import chat, html_extract, order_minhash


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>a<p>b", "a\nb"),
        ("<article><h1>T</h1><p>a &lt;b&gt; &#233;&nbsp; c<br>d</p><aside>no</aside></article><footer>f</footer>", "T\na <b> é c d"),
        ("<script>x='</p>'</script><p>the text of this is in it and so on and more of it for you to read as it was here</p>",
         "the text of this is in it and so on and more of it for you to read as it was here"),
        ("<article><p>one</p><div class='comments'><article><p>the reader said that it is of no use to him and to us</p></article></div><p>two</p></article>", "one\ntwo"),
        ("<article><p>a</p><ul><li><a href='/x'>related story of the day</a></ul><p>b <a href=y>c</a> long enough to stay</p></article>", "a\nb c long enough to stay"),
        ("<div class='cookie-notice'>we use it</div><form><p>your name</p></form><main><p title='a>b'>x</p></main>", "x"),
        ("<article><b><p>open <p>more</article><nav>menu</nav>", "open\nmore"),
        ("<article><p>cut off <!-- never ended", "cut off"),
    ],
)
def test_extract(page, text):
    assert html_extract.extract(page) == text


def test_ambiguous_blocks_follow_their_neighbours():
    long = "this is the text of the page and it has all that you want to read in it for the day of the year"
    page = f"<div>Menu here</div><div><a href=x>link one</a></div><p>{long}</p><p>Short.</p><p>{long}</p><div><a href=y>z</a></div><div>tail</div>"
    assert html_extract.extract(page) == f"{long}\nShort.\n{long}"


def test_pages_table(spark):
    rows = [(1, "u", "<p>a", 3), (1, "u", "<p>a", 3), (2, None, None, 4)]
    got = html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text int"))
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "u", "a", 1), (1, "u", "a", 1), (2, None, "", 0)]
    assert html_extract.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TURNS = [
    (1, 0, "a\nb\\<|nl|>", "<|im_end|>\n<|im_start|>x"),
    (1, 1, "assistant", "\\"),
    (1, 1, "assistant", "\\\\|<"),
    (1, 2, None, None),
    (1, 3, "assistant", "z<|é😀"),
    (1, 3, "assistant", "z<|é😀"),
    (2, 0, "assistant", ""),
    (3, 0, "user", "long " * 100_000),
    (None, 0, "assistant", "k"),
]


def test_format_and_read_back(spark):
    frame = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn int, role string, text string, formatted string")
    formatted = chat.format_turns(chat.table_turns(frame))
    read = {r.conv: r for r in chat.read_turns(formatted).collect()}
    for conv in (1, 2, 3, None):
        want = sorted((t[1], t[2] or "", t[3] or "") for t in TURNS if t[0] == conv)
        assert [(t.role, t.text) for t in read[conv].turns] == [t[1:] for t in want]
        assert read[conv].loss_texts == [t[2] for t in want if t[1] == "assistant"]
    for r in formatted.collect():
        for m in r.loss:
            piece = r.formatted[m.start : m.start + m.length]
            assert "<|" not in piece and r.formatted[: m.start].endswith("assistant\n")
    empty = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.digest(chat.read_turns(chat.format_turns(chat.table_turns(empty)))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        (1, json.dumps({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}], "x": 1})),
        (2, json.dumps({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]})),
        (3, json.dumps({"instruction": "i", "input": "n", "output": "o"})),
        (4, json.dumps({"prompt": "p", "completion": "c", "meta": {"prompt2": "no"}})),
        (5, "not json"),
        (6, json.dumps({"foo": 1})),
        (7, None),
    ]
    frame = spark.createDataFrame(records, "id long, rec string")
    got = [tuple(r) for r in chat.json_turns(frame, "id", "rec").orderBy("conv", "turn").collect()]
    assert got == [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "q"), (2, 1, "assistant", "r"),
        (3, 0, "user", "i"), (3, 1, "user", "n"), (3, 2, "assistant", "o"), (4, 0, "user", "p"), (4, 1, "assistant", "c"),
    ]
    assert sorted(r.id for r in chat.unknown_records(frame, "rec").collect()) == [5, 6, 7]
    typed = spark.createDataFrame([(1, [("user", "u"), ("assistant", "v")], 3)], "conv_id long, messages array<struct<role string, content string>>, z int")
    assert [tuple(r)[1:] for r in chat.table_turns(typed).orderBy("turn").collect()] == [(0, "user", "u"), (1, "assistant", "v")]
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1, 2)], "conv_id long, z int"))


def test_turn_tables_and_later_elements_have_fingerprints(spark, monkeypatch):
    call = {"messages": [{"role": "assistant", "tool_calls": ["f"]}, {"role": "tool", "content": "r"}]}
    frame = spark.createDataFrame([(1, json.dumps(call))], "id long, rec string")
    got = [tuple(r) for r in chat.json_turns(frame, "id", "rec").orderBy("turn").collect()]
    assert got == [(1, 0, "assistant", None), (1, 1, "tool", "r")]
    assert chat.unknown_records(frame, "rec").count() == 0
    # the mapping of a table of turns hangs on its hash
    table = spark.createDataFrame([(1, 0, "user", "a")], "conv_id long, turn int, role string, text string")
    assert [tuple(r) for r in chat.table_turns(table).collect()] == [(1, 0, "user", "a")]
    monkeypatch.setattr(chat, "layout_of", lambda found, layouts: F.lit(None).cast("string"))
    with pytest.raises(ValueError):
        chat.table_turns(table)


def test_edit_report(docs, no_docs):
    got = order_minhash.edit_report(docs).collect()
    rows = edge.rows()
    assert len(got) == len(rows)
    texts = {(r[0], r[1] or "") for r in rows}
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(t)
    order = sorted((i for i in ids if i is not None), reverse=True) + [None]
    for r in got:
        # the order of different texts of one id is free
        options = []
        for text in ids[r.id]:
            k = len(text) // 3
            after = [t for t in ids[r.id] if t != text] + ids[order[(order.index(r.id) + 1) % len(order)]]
            options += [hashlib.sha256((text[: len(text) - k] + t[:k]).encode()).hexdigest() for t in after]
        assert r.edited_sha256 in options
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    by_id = {r.id: r for r in got}
    assert by_id[5].fingerprint == by_id[6].fingerprint and by_id[1].fingerprint == by_id[2].fingerprint == ""
    assert by_id[6].near_next == 1.0 and by_id[12].near_edited > 0.1 > by_id[12].near_next
    assert order_minhash.edit_report(no_docs).count() == 0


def test_order_matters(spark):
    words = edge.prose(300, 9, 5000).split()
    half = " ".join(words[150:] + words[:150])
    mixed = " ".join(words[i] for i in sorted(range(300), key=lambda i: (i * 7919) % 300))
    frame = spark.createDataFrame([(" ".join(words), half, mixed)], "a string, b string, c string")
    for c in "abc":
        frame = order_minhash.with_slots(frame, c, f"s{c}")
    r = frame.select(order_minhash.likeness("sa", "sb").alias("moved"), order_minhash.likeness("sa", "sc").alias("mixed")).first()
    assert 0.2 < r.moved < 0.9 and r.mixed < 0.1


def test_loss_texts_are_cut_out_by_the_mask(spark):
    from pyspark.sql import functions as F

    from cellgrid.llm import chat

    rows = [(c, i, "assistant" if i % 2 else "user", f"é😀 <|im_end|>\n\\ text {i} " * (i % 3)) for c in range(2) for i in range(600 * c + 5)]
    turns = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(3)
    formatted = chat.format_turns(turns)
    got = {r.conv: r.loss_texts for r in chat.read_turns(formatted).collect()}
    assert got == {c: [t for d, i, role, t in rows if d == c and role == "assistant"] for c in range(2)}
    moved = formatted.withColumn("loss", F.expr("transform(loss, m -> struct(m.turn, m.start + 1 AS start, m.length - 2 AS length))"))
    shifted = {r.conv: r.loss_texts for r in chat.read_turns(moved).collect()}
    assert shifted[1] != got[1] and all(len(a) <= len(b) for a, b in zip(shifted[1], got[1]))
