"""What of the documents a dictionary holds."""

from pyspark.sql import functions as F

from kinweave.llm import language


def test_later_parts_in_dictionary(spark):
    header = "permission is hereby granted free of charge to any person obtaining a copy " * 9
    word = lambda i, k: "".join(chr(97 + int(d)) for d in f"{i:04d}{k:04d}")
    rows = [(i, header + " ".join(word(i, k) for k in range(400)), "en") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    own = language.learn_languages(docs, F.lit(True))["en"].decode()
    assert len(own) <= language.DICTIONARY_BYTES
    found = [w for w in own.split() if len(w) == 8 and set(w) <= set("abcdefghij")]
    assert len({w[:4] for w in found}) > 300
    assert 0.4 < sum(len(w) + 1 for w in found) / len(own) < 0.6
    # places differ from text to text
    assert len({w[4:] for w in found}) > 200
