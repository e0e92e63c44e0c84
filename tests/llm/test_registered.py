"""The registered queries as they stand: against their SQL, the tokenizers library, and plain loops over whole texts."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import language, quality, queries
from kinweave.llm.shared import crc_text

from .common import edge_docs

SQL = queries.oracle_sql()
SPACE = " \t\n\x0b\x0c\r"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = queries.queries()[name](spark, sf)
    cols = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({SQL[name]}) z").fetchall()
    got = [tuple(r) for r in df.select(*cols).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and want


def test_bpe_digests(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    want = {}
    for r in queries.table(spark, sf, "documents").collect():
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids
        back = t.decode(ids, skip_special_tokens=False)
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert {r[0]: tuple(r)[1:4] for r in queries.op4_bpe(spark, sf).collect()} == want


# quality


def plain_statistics(text):
    """STATISTICS by name, one character after the other."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [word] if word else []
            word = ""
        else:
            word += c
    capital = lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ"
    symbols, marks = "#$%&*@^~=+<>{}[]\\_/", "!?"
    count = lambda s, chars: sum(c in chars for c in s)
    caps = [sum(map(capital, w)) for w in words]
    n, w, lines = max(len(text), 1), max(len(words), 1), text.count("\n") + 1
    return {
        "chars": len(text),
        "words": len(words),
        "word_len": sum(map(len, words)) / w,
        "capitals": sum(map(capital, text)) / n,
        "digits": count(text, "0123456789") / n,
        "stops": count(text, ".,;:") / w,
        "marks": count(text, marks) / w,
        "symbols": count(text, symbols) / w,
        "bars": count(text, "|") / w,
        "lines": lines,
        "line_len": len(text) / lines,
        "first_caps": sum(k > 0 for k in caps) / w,
        "all_caps": sum(k >= 2 and 2 * k >= len(x) for k, x in zip(caps, words, strict=True)) / w,
        "doubled": sum(a == b for a, b in zip(words, words[1:], strict=False)) / w,
        "distinct": len({*words}) / w,
        "long_words": sum(len(x) > 14 for x in words) / w,
        "symbol_words": sum(count(x, symbols) > 0 for x in words) / w,
        "mark_words": sum(count(x, marks) > 0 for x in words) / w,
    }


def test_statistics(spark, sf):
    odd = ["ÀÉß ÞX Ab|c #tag [x] wow!! wow!! a_very_long_word_indeed\n\n\x0bend;", "\U0001f926 ×× %%% 12 12 12", "x" * 15 + " " + "é" * 14]
    for docs in (edge_docs(spark, odd).filter("doc_id IS NOT NULL"), queries.table(spark, sf, "documents")):
        want = {r["doc_id"]: plain_statistics(r["text"]) for r in docs.select("doc_id", "text").collect()}
        found = quality.text_statistics(docs).collect()
        assert len(found) == len(want)
        for r in found:
            own = want[r["doc_id"]]
            assert all(math.isclose(r[k], own[k], abs_tol=1e-12) for k in quality.STATISTICS), (r, own)


def test_rows_fitted_are_bounded(spark, monkeypatch):
    """Labels of ids that many rows have: no more than ``most_labelled`` rows come to the driver."""
    docs = spark.range(3000).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    sizes, fit = [], quality.fit_rules
    monkeypatch.setattr(quality, "fit_rules", lambda df, *a, **k: sizes.append(df.count()) or fit(df, *a, **k))
    quality.fit_quality(docs, labels, most_labelled=10)
    quality.fit_quality(docs, labels, most_labelled=500)
    assert sizes == [10, 500]


def test_scores_are_sums_of_rules(spark, sf):
    docs = queries.table(spark, sf, "documents")
    held_out = lambda c: F.coalesce(crc_text(F.col(c)) % 3 == 1, F.lit(False))
    model = quality.fit_quality(docs, queries.table(spark, sf, "labels"), learn=~held_out("__id"))
    assert model.rules
    scored = {r["doc_id"]: r for r in queries.op2_quality(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        x = plain_statistics(r["text"])
        total = model.intercept + sum(v for rule, v in model.rules if all(low < x[k] <= high for k, low, high in rule.bounds))
        own = scored[r["doc_id"]]
        assert math.isclose(own["score"], 1 / (1 + math.exp(-total)), rel_tol=1e-9)
        assert own["predicted"] == (own["score"] >= 0.5)


# language


def plain_language(text, contents):
    """(language, share by which the runner-up is larger): every block through every dictionary."""
    import zstandard

    kept = "".join(c if c.isalnum() and not c.isdecimal() else " " for c in (text or "").lower())
    if not any(c.isalpha() for c in kept):
        return "und", 0.0
    raw = "".join(c for i, c in enumerate(kept) if c != " " or i == 0 or kept[i - 1] != " ").encode()
    sizes = []
    for lang, content in contents.items():
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=language.LEVEL)
        packer = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
        sizes.append((sum(len(packer.compress(raw[i : i + language.BLOCK_BYTES])) for i in range(0, len(raw), language.BLOCK_BYTES)), lang))
    best = min(sizes, key=lambda s: s[0])
    rest = min(n for n, lang in sizes if lang != best[1])
    return best[1], (rest - best[0]) / rest


def test_language_is_the_smallest_encoding(spark, sf):
    docs = queries.table(spark, sf, "documents")
    held_out = lambda c: F.coalesce(crc_text(F.col(c)) % 4 == 2, F.lit(False))
    contents = language.learn_languages(docs, ~held_out("__id"))
    found = {r["doc_id"]: r for r in queries.op9_language(spark, sf).collect()}
    for r in docs.select("doc_id", "text").collect():
        lang, margin = plain_language(r["text"], contents)
        own = found[r["doc_id"]]
        assert own["lang_pred"] == lang
        assert own["rejected"] == (margin < language.MARGIN)
