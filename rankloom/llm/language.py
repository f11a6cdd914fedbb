"""Language identification by compression with per-language zstandard raw-content dictionaries.

From a bounded sample of labelled rows (``per_language`` whole texts per language, chosen by a hash of the
text) the texts of a language become one raw-content dictionary, each by the middle of all its letters: its share of
``dictionary_bytes``, or more where other texts are shorter. Texts are reduced to runs of letters in
lower case, one blank between them. A text is cut into pieces of ``piece`` bytes, each piece is compressed with every dictionary, and the language with the smallest sum wins; pieces
keep the dictionary near, so that a long text cannot serve as its own. Every byte of every text counts. The
margin is the share of bytes that the best language saves against the second best; below ``min_margin`` the
text is rejected. The score is ``1 - 2 ** (-bits)`` for ``bits`` = 8 times the bytes saved, over pieces: how
sure a piece of average size is.

The dictionaries, at most ``per_language`` texts each and ``dictionary_bytes`` long, travel with the task
code. Prediction is one narrow pass: no shuffle, and a hot source or language does not matter.

Defined cases: null, empty and letterless texts give ``und`` with score 0 and are rejected; without labelled
rows everything is ``und``; equal sums go to the language first by code point; equal texts get equal results;
very long texts are read piece by piece. All input columns are kept in a struct by the callers that need them.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm import arrays as A
from rankloom.llm.common import giving_back
from rankloom.session import cut_lineage

UNKNOWN = "und"
#: Most rows of the sample's list (a language and a hash) or of the languages' counts that are sent to every task.
MAX_SENT_ROWS = 100_000
_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> bytes:
    """The text's runs of letters in lower case with a blank around each; empty without any letter."""
    found = _NO_LETTERS.sub(" ", (text or "").lower()).strip()
    # What is left may still be numerals of other kinds only.
    return f" {found} ".encode() if any(c.isalpha() for c in found) else b""


def learn_dictionaries(
    docs: DataFrame,
    learn_from: Column,
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = 96,
    dictionary_bytes: int = 112 << 10,
) -> dict[str, bytes]:
    """One raw-content dictionary per language, from a bounded sample of labelled rows."""
    order = F.xxhash64("text")
    pool = docs.where(learn_from & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    )
    # First the hashes alone. Of a language with n of them only those in a share that holds a quarter more than wanted, and
    # some for small numbers, are ordered: the smallest ``per_language`` are far below, and no language fills a task.
    hashes = cut_lineage(pool.select("lang", order.alias("h")).distinct())
    wanted = 1.25 * per_language + 100
    counts = cut_lineage(hashes.groupBy("lang").agg((F.lit(wanted) / F.count(F.lit(1))).alias("share")))
    near = hashes.join(F.broadcast(counts) if counts.count() <= MAX_SENT_ROWS else counts, "lang").where(F.col("h") / float(1 << 64) + 0.5 <= F.col("share"))
    rank = Window.partitionBy("lang").orderBy("h")
    chosen = near.select("lang", "h", F.row_number().over(rank).alias("r")).where(F.col("r") <= per_language)
    chosen = cut_lineage(chosen.drop("r"))
    # At most per_language rows of each language: sent to every task unless there are very many languages.
    sent = F.broadcast(chosen) if chosen.count() <= MAX_SENT_ROWS else chosen

    def middles(batches):
        seen = set()
        for part in (part for batch in batches for part in A.slices(batch, "text")):
            rows = []
            for lang, h, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if (lang, h) not in seen:
                    seen.add((lang, h))
                    raw = letters(text)
                    size = min(len(raw), dictionary_bytes)
                    rows.append({"lang": lang, "h": h, "raw": raw[(len(raw) - size) // 2 :][:size]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("raw", pa.binary())]))

    # Whole texts are read in the task; of their letters the middle comes back, no more than a dictionary holds.
    sample = pool.withColumn("h", order).join(sent, ["lang", "h"]).select("lang", "h", "text").mapInArrow(middles, "lang string, h long, raw binary")
    # Equal texts once.
    found: dict[str, list[bytes]] = {}
    for row in sorted(sample.groupBy("lang", "h").agg(F.max("raw").alias("raw")).collect()):
        found.setdefault(row.lang, []).append(bytes(row.raw))
    share = max(1, dictionary_bytes // per_language)
    out = {}
    for lang, raw in sorted(found.items()):
        # Each text gives its share from its middle first, so that no long text fills the dictionary alone.
        room = dictionary_bytes
        parts = []
        for i, text in enumerate(sorted(raw, key=len)):
            size = min(len(text), max(share, room // (len(raw) - i)))
            parts.append(text[(len(text) - size) // 2 :][:size])
            room -= size
        out[lang] = b"".join(parts)
    return out


def with_language(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    text_col: str = "text",
    min_margin: float = 0.002,
    piece: int = 4096,
    level: int = 3,
) -> DataFrame:
    """All rows with ``lang_pred``, ``score``, ``margin`` and ``rejected``; these replace columns of equal name."""
    added = ("lang_pred", "score", "margin", "rejected")
    kept = [c for c in docs.columns if c not in added]
    schema = docs.select(*kept).schema
    for name, kind in (("lang_pred", "string"), ("score", "double"), ("margin", "double"), ("rejected", "boolean")):
        schema = schema.add(name, kind)
    languages = sorted(dictionaries)

    def run(batches):
        coders = []
        for lang in languages:
            known = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=level)
            coders.append(zstandard.ZstdCompressor(dict_data=known, level=level, write_checksum=False, write_content_size=False, write_dict_id=False))

        def judge(text: str | None) -> tuple[str, float, float, bool]:
            raw = letters(text)
            if not raw or not languages:
                return UNKNOWN, 0.0, 0.0, True
            cuts = range(0, len(raw), piece)
            sizes = [sum(len(c.compress(raw[i : i + piece])) for i in cuts) for c in coders]
            best = min(range(len(sizes)), key=sizes.__getitem__)
            second = min((s for i, s in enumerate(sizes) if i != best), default=len(raw) + 16 * len(cuts))
            saved = max(0, second - sizes[best])
            margin = saved / max(1, second)
            return languages[best], 1.0 - 2.0 ** (-8.0 * saved / len(cuts)), margin, margin < min_margin

        for batch in batches:
            rows = [judge(t) for t in batch.column(text_col).to_pylist()]
            columns = [batch.column(c) for c in kept]
            new = zip(*rows, strict=True) if rows else ([], [], [], [])
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [*columns, *[pa.array(list(v), t) for v, t in zip(new, types, strict=True)]], names=[*kept, *added]
            )

    return docs.mapInArrow(giving_back(run), schema)
