"""Edge rows that every text operator must take: nulls, empty and very long texts, ties, repeats, clashing columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id long, spans string, node int, listed string"


def edge_docs(spark, extra=()):
    r = random.Random(5)
    words = ["alpha", "Beta", "gamma", "the", "of", "déjà", "vu", "x1", "zeta", "omega"]
    base = [" ".join(r.choice(words) for _ in range(n)) for n in (1, 3, 5, 13, 40, 200)]
    long_text = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(30_000))
    texts = [None, "", " ", "\n", *base, *base[:3], base[4].upper(), base[5] + " tail", long_text, "日本語 テキスト", "a\x00b", *extra]
    rows = [(i, t, "en", None, None, 7, "s", 3, "l") for i, t in enumerate(texts)]
    rows += [(None, base[0], None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
