"""Language ID by compression: a text's language is the one whose dictionary compresses it best.

Per language a raw-content zstandard dictionary is made of excerpts from labelled documents: about ``sample_docs``
documents a language, chosen by a hash of id and text, each with an equal share of ``dictionary_bytes``: half of it from
the text's start, half from a later place, in excerpts of at most ``excerpt_chars``. These three bounds of the labelled
sample, and of what is broadcast for each language, are arguments of ``learn_languages``. Every whole text is then cut into blocks (so that the dictionary, not the text's own
past, does the work), each block is encoded with every dictionary, and the sizes are summed. The smallest sum wins;
where the runner-up is less than ``margin`` larger, the prediction is marked as rejected. One pass, no shuffle.

A null text, or one without a letter, is ``und`` with score 0; so is everything when nothing was learned.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import slices

SAMPLE_DOCS = 400
EXCERPT_CHARS = 600
DICTIONARY_BYTES = 96_000
BLOCK_BYTES = 4096
LEVEL = 3
MARGIN = 0.01
LETTER = re.compile(r"[^\W\d_]")
OTHER = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> bytes:
    """The lower-cased letters; whatever stands between them is one space."""
    return OTHER.sub(" ", text.lower()).encode("utf-8", "surrogatepass")


def learn_languages(
    docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    sample_docs: int = SAMPLE_DOCS, excerpt_chars: int = EXCERPT_CHARS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Dictionary contents by language, the most frequent first, from rows where ``learn`` (over ``__id``) holds and the
    language isn't null. ``sample_docs`` labelled documents of a language are read on average (all, where it has fewer),
    of each ``excerpt_chars`` at its start and as many further on; a dictionary has at most ``dictionary_bytes``."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(lang_col).alias("__lang"))
    rows = rows.filter(learn & F.col("__lang").isNotNull() & F.col("__text").rlike(r"\p{L}"))
    counts = {r["__lang"]: r["count"] for r in rows.groupBy("__lang").count().collect()}
    if not counts:
        return {}
    share = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("__lang") == lang, F.lit(min(1.0, sample_docs / n))).otherwise(share)
    place = F.xxhash64("__id", "__text")
    picked = rows.filter(F.pmod(place, F.lit(1 << 30)) < share * (1 << 30))
    # A later part of the text as well as its start, so that boilerplate at the top doesn't fill the dictionary: from the
    # middle of a short text, from a place chosen by hash beyond the first excerpt of a long one.
    length = F.length("__text")
    free = F.greatest(F.lit(1), length - 2 * excerpt_chars + 1)
    begin = F.least(F.lit(excerpt_chars), F.floor(length / 2)) + F.pmod(F.xxhash64("__text", "__id"), free) + 1
    start, later = F.substring("__text", 1, excerpt_chars), F.substring(F.col("__text"), begin.cast("int"), F.lit(excerpt_chars))
    by_lang: dict[str, list[tuple[bytes, bytes]]] = defaultdict(list)
    for r in picked.select("__lang", place.alias("place"), start.alias("start"), later.alias("later")).orderBy("__lang", "place").toLocalIterator():
        by_lang[r["__lang"]].append((letters_of(r["start"]), letters_of(r["later"])))
    out = {}
    for lang, parts in sorted(by_lang.items(), key=lambda x: (-counts[x[0]], x[0])):
        size = max(200, dictionary_bytes // len(parts))
        half = size // 2
        out[lang] = b" ".join(p for pair in parts for p in (pair[0][:half], pair[1][: size - half - 1]))[:dictionary_bytes]
    return out


class Encoders:
    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)  # of equal sizes the first wins: the most frequent language
        self.encode = []
        for lang in self.langs:
            own = zstandard.ZstdCompressionDict(contents[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=LEVEL)
            packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False)
            self.encode.append(packer.compress)

    def sizes(self, text: str) -> list[int]:
        raw = letters_of(text)
        blocks = [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]
        return [sum(len(encode(b)) for b in blocks) for encode in self.encode]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """(language, score, margin): the margin is the share by which the runner-up is larger."""
        if not text or not self.langs or not LETTER.search(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        rest = min((s for i, s in enumerate(sizes) if i != best), default=None)
        margin = 1.0 if rest is None else (rest - sizes[best]) / rest
        return self.langs[best], min(1.0, 0.5 + 5 * margin), margin


def identify_languages(
    docs: DataFrame, contents: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text", margin: float = MARGIN
) -> DataFrame:
    """(id_col, lang_pred, score, rejected) for every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(contents)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = Encoders(sent.value)
        for whole in batches:
            for batch in slices(whole, text_col):
                found = [coders.predict(t) for t in batch.column(text_col).to_pylist()]
                langs, scores, margins = zip(*found, strict=True) if found else ((), (), ())
                columns = [batch.column(id_col), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([m < margin for m in margins], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "rejected"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(id_col, text_col).mapInArrow(predict, f"id {kind}, lang_pred string, score double, rejected boolean")
    return out.withColumnRenamed("id", id_col)
