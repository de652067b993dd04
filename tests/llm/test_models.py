"""Held-out accuracy of the two learned operators, and the pipeline on planted cases."""

import os
import random

import pytest
from helpers import SCHEMA, prose, table

from segspan.llm import htmlblocks, langid, train_blocks

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs, langid.fit(docs)).where("held_out").join(docs, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)


def test_bloom_masks():
    import numpy as np

    slots = np.zeros(1 << 10, np.uint8)
    model = langid.Filters(("a", "b"), slots, 3, np.zeros(2), 0)
    keys = np.arange(50, dtype=np.uint32)
    assert not model.masks(keys).any()
    b = "héllo wörld".encode()
    got, bounds = langid.ngrams(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
    assert bounds.tolist() == [0, len(got)] and got[0] == int.from_bytes(b" h\xc3\xa9", "big")


def test_block_accuracy():
    labeller = htmlblocks.Labeller.load(htmlblocks.MODEL.read_bytes())
    assert train_blocks.accuracy(labeller, train_blocks.sample(99, 200)) >= 0.98


def test_extract(spark):
    page = '<html><head><title>t</title></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A title</h1><p>First   part &amp; more.<p><b>Second</b> part\n of it.</article><div class="comments"><p>I disagree with this.</p></div><footer>&copy; Someone</footer></body></html>'
    row = htmlblocks.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert row.text == "A title First part & more. Second part of it." and row.n_chars == len(row.text)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(4)
    syllables = {"en": ["the", "ing", "and", "er", "wh"], "de": ["sch", "ein", "ung", "ge", "ü"]}
    text = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))
    rows = [(k, text(lang, 120), lang, f"s{k % 3}", 0) for k, lang in enumerate(["en", "de"] * 40)]
    item = " ".join(rows[0][1].split()[10:40])
    rows += [(100, rows[3][1], "de", "s0", 0), (101, "12345 !!! 777", "en", "s1", 0), (102, text("en", 30) + " " + item, "en", "s2", 0), (103, text("en", 40) + " " + " ".join(rows[4][1].split()[20:90]), "en", "s0", 0)]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {x.doc_id for x in df.collect()}
    every = set(range(80)) | {100, 101, 102, 103}
    stage = dict(corpus_pipeline.STAGES)
    assert ids(stage["language_id"](spark, docs, str(tmp_path))) == every - {101}
    assert ids(stage["near_duplicates"](spark, docs, str(tmp_path))) == every - {100}
    cut = {x.doc_id: x.text for x in stage["substring_dedup"](spark, docs, str(tmp_path)).collect()}
    assert set(cut) == every - {100} and len(cut[103].split()) == 40 and cut[5] == rows[5][1]
    assert ids(stage["decontamination"](spark, docs, str(tmp_path))) == every - {0, 102}
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "taken"]
    assert ids(out) <= every - {100, 101, 0, 102}
