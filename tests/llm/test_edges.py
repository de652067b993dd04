"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import random

import pytest
from helpers import SCHEMA, corpus, odd_columns, prose, table
from pyspark import cloudpickle

from segspan.llm import bytesop, chaining, chat, decontam, htmlblocks, jaccard, langid, lengths, mixing, search, suffix

BENCH = "item_id long, text string"
OPERATORS = {
    "langid": lambda d, b: langid.identify(d, langid.fit(d)),
    "identified": lambda d, b: langid.identified(d, langid.fit(d), 0.2),
    "decontam": lambda d, b: decontam.digest(decontam.contamination(d, b)),
    "clean": decontam.clean,
    "jaccard": lambda d, b: jaccard.near_duplicates(d),
    "one_of_each": lambda d, b: jaccard.one_of_each(d),
    "mix": lambda d, b: mixing.mix(d),
    "suffix": lambda d, b: suffix.substring_dedup(d),
    "chaining": lambda d, b: chaining.fuzzy_dedup(d),
    "without_passages": lambda d, b: chaining.without_passages(d),
    "search": lambda d, b: search.top_k(d, d.where("doc_id % 20 = 0")),
    "lengths": lambda d, b: lengths.token_counts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], BENCH)
    assert OPERATORS[name](docs, bench).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    r = random.Random(2)
    rows = corpus(3, 20)[-30:]
    rows += [rows[0], rows[0], (None, prose(r, 80), None, None, None), (None, None, None, None, None), (500, prose(r, 20_000), "en", "a", 1), (500, "another text of the same id", "en", "a", 2)]
    docs, bench = table(spark, rows), spark.createDataFrame([(1, None), (2, ""), (3, prose(r, 30)), (3, "short one"), (None, "x y z")], BENCH)
    plain = sorted(map(str, (row.asDict() for row in OPERATORS[name](docs, bench).collect())))
    extra = OPERATORS[name](odd_columns(docs), bench)
    keeps_rows = name in ("identified", "clean", "one_of_each", "without_passages")
    got = sorted(map(str, (({k: v for k, v in row.asDict().items() if k in SCHEMA_NAMES} if keeps_rows else row.asDict()) for row in extra.collect())))
    assert got == plain
    if keeps_rows:
        assert extra.columns == odd_columns(docs).columns
    if name in ("langid", "decontam", "jaccard", "mix", "suffix", "chaining"):
        assert len(plain) == len(rows)


SCHEMA_NAMES = {c.split()[0] for c in SCHEMA.split(", ")}


def test_chat_edges(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert chat.perspectives(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 0, "user", "hi <|im_end|> <\\|"), (1, 1, None, None), (1, None, "bob", "x"), (1, 1, None, None), (None, 0, "user", ""), (2, 0, "system", "only"), (1, 300, "user", "late")]
    turns = spark.createDataFrame(rows, kind)
    got = {(x.conv_id, x.speaker, x.part): x for x in chat.perspectives(turns, part_turns=256).collect()}
    assert {k[:2] for k in got} == {(1, "user"), (1, "unknown"), (1, "bob"), (None, "user")}
    assert {k[2] for k in got if k[:2] == (1, "user")} == {None, 0, 1}
    x = got[(1, "user", 0)]
    assert x.n_turns == 3 and x.text.count("<|im_end|>") == 3 and "<\\|im_end|> <\\\\|" in x.text
    assert [x.text[m.start : m.end] for m in x.masks] == ["hi <\\|im_end|> <\\\\|<|im_end|>"]
    whole = {(x.conv_id, x.speaker): x for x in chat.perspectives(turns).collect()}
    x = whole[(1, "user")]
    assert x.part == 0 and x.n_turns == 5 and x.text.index("name=bob") < x.text.index("hi ") < x.text.index("late")
    assert [x.text[m.start : m.end] for m in x.masks] == ["hi <\\|im_end|> <\\\\|<|im_end|>", "late<|im_end|>"]


def test_long_dialogue(spark):
    """Three thousand turns in one row; masks are where the speaker's texts are. Roles with line feeds stay on their line."""
    rows = [(1, k, ("a", "b\nc", "d\\n")[k % 3], f"text {k} ü") for k in range(3000)]
    got = {x.speaker: x for x in chat.perspectives(odd_columns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert set(got) == {"a", "b\nc", "d\\n"}
    for k, name in enumerate(("a", "b\nc", "d\\n")):
        x = got[name]
        assert [x.text[m.start : m.end] for m in x.masks] == [f"text {i} ü<|im_end|>" for i in range(k, 3000, 3)]
        assert x.text.count("<|im_start|>assistant\n") == 1000 and x.text.count("\n") == 6000
    assert "name=b\\nc\n" in got["a"].text and "name=d\\\\n\n" in got["a"].text


def test_html_edges(spark):
    kind = "page_id long, url string, html string"
    assert htmlblocks.extract(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>unclosed <b>bold"), (4, "u", "<<<>>> & < b"), (None, "u", '<a href="x'), (5, "u", "<article>" + "<p>word &amp; word" * 3000)]
    got = {r.page_id: r for r in htmlblocks.extract(spark.createDataFrame(rows, kind)).collect()}
    assert len(got) == 6 and got[1].text == got[2].text == "" and got[5].n_chars == len(got[5].text)


def test_html_text_inside_paragraphs():
    """Formulas, drawings and objects are part of their paragraph; an unclosed element doesn't swallow what follows."""
    of = lambda x: [b.text for b in htmlblocks.blocks(x)]
    assert of("<p>The sum <math><mi>x</mi><mo>+</mo><mi>y</mi></math> of <object>two</object> <svg><text>terms</text></svg>.</p>") == ["The sum x+y of two terms."]
    for name in ("textarea", "select", "noscript", "title", "iframe"):
        assert "kept" in of(f"<div><{name}>open</div><p>kept</p>")
        assert of(f"<div><{name}>gone</{name}></div><p>kept</p>") == ["kept"]
    assert of("<p>kept</p><script>var open = '<p>';") == ["kept"]


def test_more_languages_than_bits(spark):
    """Seventy invented languages, each with its own words."""
    r = random.Random(4)
    words = [["".join(r.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(30)] for _ in range(70)]
    rows = [(k, " ".join(r.choice(words[k % 70]) for _ in range(40)), f"l{k % 70:02}", "a", 0) for k in range(1400)]
    docs = table(spark, rows)
    got = {x.doc_id: x for x in langid.identify(docs, langid.fit(docs)).collect()}
    held = [k for k, *_ in rows if got[k].held_out]
    assert len(held) > 200 and sum(got[k].lang_pred == f"l{k % 70:02}" for k in held) >= 0.99 * len(held)


def test_mix_spreads_rows_without_id(spark):
    rows = [(None, f"w{k} x y", "en", "a", 0) for k in range(200)] + [(k, f"a b{k}", "en", "b", 0) for k in range(50)]
    docs = table(spark, rows)
    first = sorted(map(str, mixing.mix(docs, rows_as="whole").collect()))
    assert first == sorted(map(str, mixing.mix(docs.repartition(7), rows_as="whole").collect()))
    taken = {}
    for x in mixing.mix(docs).collect():
        taken[x.source] = taken.get(x.source, 0) + x.taken
        assert x.taken <= 3 * x.size
    assert taken == {"a": 400, "b": 300}


def test_functions_travel_without_the_caches_of_the_driver():
    bytesop.powers(10)
    for run in (chaining._picks, jaccard.document_sets, decontam.contamination):
        assert len(cloudpickle.dumps(run)) < 1 << 18
