"""Texts, pages and label sets that crash or stall a careless operator."""

import random
import time
from pathlib import Path

import pytest
from helpers import SCHEMA, odd_columns, table

from segspan.llm import htmlblocks, langid, lengths

WIDE = "".join(chr(c) for c in (0x20, 0x09, 0x0A, 0x0D, 0x85, 0xA0, 0x2003, 0x2028, 0x3000))


def test_white_space_is_counted_as_the_splitter_does():
    encoding, r = lengths.encoder(Path(lengths.VOCABULARY).read_bytes()), random.Random(1)
    for _ in range(150):
        parts = [r.choice(["word", "x1", "\x1c", "'s", "é", "!", r.choice(WIDE) * r.choice([1, 2, 999, 1000, 1500]), "".join(r.choice(WIDE) for _ in range(r.choice([3, 1200])))]) for _ in range(r.randrange(1, 8))]
        assert lengths.count_tokens(encoding, "".join(parts)) == len(encoding.encode_ordinary("".join(parts)))


def test_millions_of_spaces(spark):
    texts = [" " * 3_000_000, "a" + " \n" * 1_500_000 + "b", "\n" * 3_000_000 + "x", "x" * 1_000_000]
    got = lengths.token_lengths(table(spark, [(k, t, None, None, None) for k, t in enumerate(texts)])).collect()
    assert len(got) == 4 and all(x.n_tokens > 1000 for x in got)


@pytest.mark.parametrize("page", ["<select>x" * 110_000, "<font>x<br>" * 95_000, "<b>" * 160_000 + "</i>" * 160_000, "<b>" * 120_000 + "<p>x</p>" * 80_000, "<p><button>" + "<b>" * 120_000 + "<hr>" * 120_000, '<a ">' * 200_001, "<!-- " * 200_000, "<" * 1_000_000])
def test_pages_of_a_megabyte_take_seconds(page):
    began = time.time()
    htmlblocks.blocks(page)
    assert time.time() - began < 30


def test_html_columns_that_clash(spark):
    rows = [(k, "u", f"<p>text {k} of it</p><div><select>no</select>more</div>") for k in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(map(tuple, htmlblocks.extract(odd_columns(pages)).collect())) == sorted(map(tuple, htmlblocks.extract(pages).collect()))


def test_thousands_of_labels(spark):
    """Every label is learnt; a third of the rows have one label."""
    r = random.Random(7)
    word = lambda k: f"{'abcdefghijklmnop'[k % 16]}{'abcdefghijklmnop'[k // 16 % 16]}{'abcdefghijklmnop'[k // 256 % 16]}q{k}"
    rows = [(k, " ".join([word(k % 3000 if k % 3 else 0)] * r.randrange(3, 6)), f"l{k % 3000 if k % 3 else 0:04}", "a", 0) for k in range(9000)]
    model = langid.fit(table(spark, rows, SCHEMA), least=1)
    assert len(model.languages) > 1500
    got = langid.identify(table(spark, rows[:50], SCHEMA), model).collect()
    assert len(got) == 50
