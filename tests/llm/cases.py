"""Documents with what real tables hold: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, count long, _id string, found string, rid string, key string"


def texts(n=120, seed=3):
    rng = random.Random(seed)
    words = "the of and to in amber river stone cloud idle forest market winter paper silver garden window bridge candle yellow".split()
    return [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(n)]


def docs(spark, extra=()):
    t = texts()
    rows = [(i, x) for i, x in enumerate(t)]
    rows += [(1000, None), (1001, ""), (1002, None), (None, "a null identifier"), (1003, "   \n\t "), (1004, t[0]), (1005, t[0]), (1005, t[0]), (1006, "word " * 60_000), (1007, "Ünïcödé «ß» 日本 \U0001f600 x")]
    rows += list(extra)
    return spark.createDataFrame([(i, x, None if i is None else "en", f"s{(i or 0) % 3}" if i != 7 else None, None, 1, "a", "b", "c", "d") for i, x in rows], SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
