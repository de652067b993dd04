import random
import re

from pyspark.sql import functions as F

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def prose(r, n, words=None):
    words = words or 4000
    return " ".join(f"w{r.randrange(words)}" for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with exact copies, near copies, shared passages, repeated lines, ties and odd texts."""
    r = random.Random(seed)
    texts = [prose(r, r.choice([3, 8, 60, 150])) for _ in range(n)]
    passage = prose(r, 70)
    for k in range(0, n, 6):
        texts[k] += " " + passage + " " + prose(r, 10)
    texts += [texts[5], texts[5], texts[7].upper()]
    for k in (9, 10, 11, 12):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    base = prose(r, 120).split()
    for _ in range(25):  # a large group of near copies, not all linked to each other
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [None, "", "   \n", "é" * 60, "!!! ???", "one", "line again\n" * 40, "Ünïcode wörds " * 30, "same same " * 80]
    return [(k, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", None]), None if t is None else len(t)) for k, t in enumerate(texts)]


def odd_columns(df):
    """The frame with extra columns that clash with names the operators use inside."""
    for c in ("doc", "seed", "name", "start", "size", "sid", "rep", "n", "pivot", "ranges", "spans", "range", "key", "taken", "q", "term", "score", "component_id", "items", "h", "l", "t", "s", "row", "d0", "tie", "__doc", "__spans", "__first", "__n"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def table(spark, rows, schema=SCHEMA, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)
