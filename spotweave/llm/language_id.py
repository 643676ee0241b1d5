"""Language identification by compression: each text is compressed with one raw-content zstandard dictionary per
language, and the language that leaves the fewest bytes wins; narrow margins are rejected. A text is compressed whole, in
pieces of `PIECE` bytes that each start from the dictionary anew, so the margin means the same at every length: what a
dictionary can save is bounded, and in one piece its share would shrink as the text grows.

The dictionaries hold a bounded sample of the learning rows: `texts` texts of each language, those with the least
hash of their id, of each of which up to `bytes_each` bytes from its start are taken. Predictions read whole texts.
Documents never move. Each text is compressed once per language, so the work grows with the number of languages learned.

Defined cases: a null text, or one without letters (digits and number signs such as ½ or Ⅷ are none), is `und` with score 0 and rejected; a tie goes to the first
language by code point, with score 0; rows with a null language are not learned from; repeated rows each get their
result; with nothing to learn from, every text is `und`; extra columns are ignored by `identify`, kept by `identified`.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEXTS, BYTES_EACH, LEVEL = 64, 800, 5
PIECE = 32 << 10
#: Parts of a language's learning rows that are cut to its sample's size first.
PARTS = 1000
#: Reject when the best dictionary saves less than this share of what the second leaves.
MARGIN = 0.004
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letters(text: str) -> bool:
    """Whether a text has a letter; numbers such as ½, ² or Ⅷ are none."""
    return any(m[0].isalpha() for m in _WORDLIKE.finditer(text))


def letters(text: str) -> bytes:
    """What is compressed: the letters in lower case, anything between them one space."""
    return _OTHER.sub(" ", f" {text.lower()} ").encode()


def learn(docs: DataFrame, texts: int = TEXTS, bytes_each: int = BYTES_EACH) -> dict[str, bytes]:
    """Dictionary content per language from rows (doc_id, text, lang); at most texts * bytes_each bytes of each."""
    # starts of texts alone, and two windows: the first one's groups are parts of a language, so no task sees more than `texts` rows of some thousand partitions or parts
    rows = docs.where("lang is not null and text is not null").select("lang", "doc_id", F.substring("text", 1, bytes_each).alias("text"), (F.spark_partition_id() % PARTS).alias("part"))
    few = rows
    for group in (["lang", "part"], ["lang"]):
        by = Window.partitionBy(*group).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
        few = few.withColumn("k", F.row_number().over(by)).where(F.col("k") <= texts)
    found: dict[str, list[bytes]] = {}
    for lang, text in few.orderBy("lang", "k").select("lang", "text").collect():
        if has_letters(text):
            found.setdefault(lang, []).append(letters(text)[:bytes_each])
    return {lang: b"\n".join(dict.fromkeys(parts)) for lang, parts in sorted(found.items())}


class Judge:
    def __init__(self, content: dict[str, bytes], level: int = LEVEL, margin: float = MARGIN):
        self.langs, self.margin = list(content), margin
        self.packers = []
        for c in content.values():
            d = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(level, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=p)
            self.packers.append(zstandard.ZstdCompressor(dict_data=d, compression_params=p))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected); the score is the share that the best saves of what the second leaves, 1 if there is no second."""
        if not text or not self.langs or not has_letters(text):
            return UNKNOWN, 0.0, True
        raw = letters(text)
        pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        sizes = sorted((sum(len(p.compress(x)) for x in pieces), lang) for p, lang in zip(self.packers, self.langs, strict=True))
        score = (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0
        return sizes[0][1], score, score < self.margin


def identify(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        judge = Judge(shared.value, margin=margin)
        for batch in batches:
            got = [judge(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def identified(docs: DataFrame, content: dict[str, bytes], margin: float = MARGIN) -> DataFrame:
    """The documents whose language is not rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(content)

    def run(batches):
        judge = Judge(shared.value, margin=margin)
        for batch in batches:
            yield batch.filter(pa.array([not judge(t.as_py())[2] for t in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
