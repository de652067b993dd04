"""Token counts: an exact histogram of encoded lengths and its suffix sums.

One pass encodes every whole text and keeps one number per document; documents of equal length are
counted together. Suffix sums over the lengths then answer, for every context limit L, how many
documents and tokens lie at or above it and how many tokens remain if all documents are cut to L.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import Scratch, small_batches

#: Where the public vocabularies are on the driver; a parameter of `token_lengths`.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split pattern that belongs to this vocabulary (a fixed value of the public tokenizer).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that share a block of the two-level suffix sums.
BLOCK = 256


#: White space as the split pattern knows it (a fixed value), and the length from which a run is cut out before splitting.
SPACES, LONG_RUN = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000", 1000
RUN = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")
#: A long run holds two neighbours among every LONG_RUN / 2nd character.
SIGN, STEP = re.compile(f"[{SPACES}]{{2}}"), LONG_RUN // 2


def encoder(ranks: bytes):
    """A byte-level BPE from the lines `base64-token rank` of a vocabulary file."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("lengths", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def count_tokens(encoding, text: str) -> int:
    """Tokens of a whole text.

    The splitter's look-ahead takes stack for each character of a run of white space, so long runs are cut out. The
    pattern takes all but the last character of a run as one piece (all of it at the end of the text), and what stands
    before and after it is split as if it stood alone: counts stay the same.
    """
    if len(text) < LONG_RUN or not SIGN.search(text[::STEP]):
        return len(encoding.encode_ordinary(text))
    n = at = 0
    for m in RUN.finditer(text):
        end = m.end() if m.end() == len(text) else m.end() - 1
        n += len(encoding.encode_ordinary(text[at : m.start()])) + len(encoding._encode_single_piece(text[m.start() : end]))
        at = end
    return n + len(encoding.encode_ordinary(text[at:] if at else text))


def token_lengths(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row `n_tokens` for each row of `docs`; a null or empty text has 0 tokens."""
    small_batches(docs.sparkSession)
    ranks = Path(vocabulary).read_bytes()  # bounded: one vocabulary, under a megabyte

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = encoder(ranks)
        for batch in batches:
            n = [count_tokens(encoding, t) if (t := x.as_py()) else 0 for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64())], names=["n_tokens"])

    return docs.select(F.col(text).alias("text")).mapInArrow(count, "n_tokens long")


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: exact, combined before the shuffle."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For each length L that occurs: n_tokens = L, n_docs, docs_at_least, tokens_at_least, docs_below,
    truncated_total (the sum of min(length, L)), tokens_total, share_at_most (documents of at most L tokens).

    Sums run within blocks of lengths in parallel; only one row per block meets in one window.
    """
    h = histogram.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    after = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    everything = W.partitionBy()
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    docs = F.sum("n_docs").over(inside) + F.col("docs_after")
    tokens = F.sum("tokens").over(inside) + F.col("tokens_after")
    out = h.join(blocks, "block").withColumn("docs_at_least", docs).withColumn("tokens_at_least", tokens)
    below = F.col("docs_total") - F.col("docs_at_least")
    return out.select(
        "n_tokens",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        below.alias("docs_below"),
        (F.col("tokens_total") - F.col("tokens_at_least") + F.col("n_tokens") * F.col("docs_at_least")).alias("truncated_total"),
        "tokens_total",
        ((below + F.col("n_docs")) / F.col("docs_total")).alias("share_at_most"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """limit, kept_tokens, cut_docs for any context limits, whether or not a document has that length.

    Defined cases: equal limits give equal rows; an empty histogram gives 0 for each limit.
    """
    spark = histogram.sparkSession
    at = spark.createDataFrame([(int(x),) for x in limits], "limit long")
    sums = [F.sum(F.least("n_tokens", F.lit(int(x))) * F.col("n_docs")).alias(f"k{i}") for i, x in enumerate(limits)]
    cuts = [F.sum(F.when(F.col("n_tokens") > int(x), F.col("n_docs")).otherwise(0)).alias(f"c{i}") for i, x in enumerate(limits)]
    one = histogram.agg(*sums, *cuts)
    rows = F.explode(F.array(*[F.struct(F.lit(int(x)).cast("long").alias("limit"), F.coalesce(f"k{i}", F.lit(0)).alias("kept_tokens"), F.coalesce(f"c{i}", F.lit(0)).alias("cut_docs")) for i, x in enumerate(limits)]))
    return one.select(rows.alias("r")).select("r.*").join(at, "limit")


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """share, n_tokens: the smallest length that at least this share of the documents does not exceed.

    Defined cases: a share of 0 gives the smallest length, a share over 1 no row; equal shares give one row; an empty
    frame of sums gives an empty frame.
    """
    spark = sums.sparkSession
    at = spark.createDataFrame([(float(x),) for x in shares], "share double")
    return sums.join(F.broadcast(at), F.col("share_at_most") >= F.col("share")).groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(docs: DataFrame, text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The suffix sums of the encoded lengths of all rows of `docs`.

    Defined cases: null and empty texts count as documents of 0 tokens; repeated rows each count; an
    empty table gives an empty frame; strings of special tokens are ordinary text; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "lengths")
    # Written once: the suffix sums read it twice, and no text is encoded again.
    return suffix_sums(scratch.put("histogram", length_histogram(token_lengths(docs, text, vocabulary))))
