"""Small corpora with every kind of difficult row, and plain-Python references."""

from __future__ import annotations

import random
import zlib

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
# Names that operators use inside or return; such columns of the input must not disturb them.
CLASHES = ["id", "h", "n", "score", "ids", "kept_text", "n_tokens", "run", "host", "line", "word", "copies", "node", "key", "train", "toxic", "part", "whole", "rest", "cut", "ranges", "__h", "__ranges", "__drop", "__c0", "Score", "lang_Pred",
           "N_Words", "band", "at", "start", "stop", "Copies_", "__salt"]

POOL = {"en": "the of and th in er onal ing tion re sh wh ble ou ly".split(), "fr": "le la de que eux ai pour é ou ment tre".split(),
        "de": "der und zu ü ung sch en ß ein mit ver".split()}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choices(POOL[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(n: int = 120, seed: int = 5) -> list[tuple]:
    """Random texts with exact copies, near copies, shared passages and shared lines."""
    rng = random.Random(seed)
    rows, texts = [], []
    passage, line = sentence(rng, "en", 60), sentence(rng, "en", 9)
    for i in range(n):
        lang = rng.choice(list(POOL))
        kind = rng.random()
        if kind < 0.15 and texts:
            text, lang = rng.choice(texts)
        elif kind < 0.35 and texts:
            text, lang = rng.choice(texts)
            words = text.split(" ")
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "edit%d" % rng.randrange(99)
            text = " ".join(words)
        else:
            text = "\n".join(sentence(rng, lang, rng.randint(3, 40)) for _ in range(rng.randint(1, 5)))
            if rng.random() < 0.2:
                text += "\n" + passage
            if rng.random() < 0.4:
                text += "\n" + line
        texts.append((text, lang))
        rows.append((i * 3 + 1000, text, lang, f"src{rng.randrange(3)}", len(text)))
    return rows


def difficult() -> list[tuple]:
    """Nulls, empty and long texts, ties and repeated rows."""
    rng = random.Random(9)
    long = sentence(rng, "en", 30_000)
    plain = sentence(rng, "fr", 50)
    return [
        (1, plain, "fr", "src0", 1), (1, plain, "fr", "src0", 1), (2, plain, "fr", None, None), (3, None, "en", "src1", 0),
        (4, "", None, "src1", 0), (5, " \t\n ", "en", "src1", 4), (None, plain, "fr", "src2", 1), (None, None, None, None, None),
        (7, long, "en", "src2", len(long)), (8, long + " end", "en", "src2", 1), (9, "one two", "en", "src0", 7), (9, "three four five", "en", "src0", 9),
        (10, "x" * 5000, "en", "src0", 5000), (11, "$$$ ### 123", "en", "src0", 11), (12, "\U0001F600 é中", "en", "src0", 5),
    ]


def frame(spark, rows: list[tuple], clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F
        df = df.select("*", *[F.lit("clash").alias(c) for c in CLASHES])
    return df


def held(i: int, every: int) -> int:
    return zlib.crc32(str(i).encode()) % every


def words(text: str | None, lower: bool = False) -> list[bytes]:
    raw = (text or "").encode()
    return (raw.lower() if lower else raw).split()


def shingles(text: str | None) -> frozenset:
    w = words(text, True)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def linked(a: frozenset, b: frozenset) -> bool:
    return bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b)


def component_of(rows: list[tuple]) -> dict:
    """Smallest id reachable by links, from all pairs."""
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}
