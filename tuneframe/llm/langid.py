"""Language identification with bit-sliced Bloom filters of character n-grams.

All languages share one filter of slots; a slot holds a bitmask of the languages that set it. An
n-gram reads ``HASHES`` slots and ANDs them: the bits left are all languages whose filter contains
the n-gram, found in one look-up. Per language the hits over a text are counted and corrected for
the share of hits that an unknown n-gram would get by chance (the fill of its slice to the power
``HASHES``); the largest corrected share decides.

An n-gram enters the filter of a language when its share of the language's n-grams reaches
``MIN_SHARE``; shares, not counts, so the rule is the same at any size. The filter has a fixed
size (``2 ** SLOT_BITS`` slots of one byte per eight languages) and is what tasks receive.

* Null text, or none with a letter: ``und``, score 0. Ties go to the first language by code point.
* No labelled row: every text is ``und``. Very long texts are processed whole, in blocks.
* Input columns are kept unless an output has their name; repeated rows are judged alike.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import byte_rows, mix
from tuneframe.session import give_back, lean, written

GRAM = 4
HASHES = 3
SLOT_BITS = 18
MIN_SHARE = 2e-5
# Labelled rows of each language that the filters learn from, in expectation: a threshold on a hash of the row.
SAMPLE = 50_000
UNKNOWN = "und"
_BLOCK = 1 << 20
_letter_table = np.zeros(256, np.uint8)
for _c in range(ord("a"), ord("z") + 1):
    _letter_table[_c] = _c
    _letter_table[_c - 32] = _c
_letter_table[0x80:] = np.arange(0x80, 0x100)  # bytes of non-ASCII letters stay as they are


def _grams(data: np.ndarray) -> np.ndarray:
    """Byte n-grams of letters; every other byte is a word border, and runs of borders count once."""
    code = _letter_table[data]
    code = np.concatenate((np.zeros(1, np.uint8), code, np.zeros(1, np.uint8)))
    code = code[(code != 0) | np.concatenate((np.ones(1, bool), code[:-1] != 0))]
    if len(code) < GRAM:
        return np.zeros(0, np.uint32)
    wide = code.astype(np.uint32)
    out = wide[: len(wide) - GRAM + 1].copy()
    for i in range(1, GRAM):
        out = (out << np.uint32(8)) | wide[i : len(wide) - GRAM + 1 + i]
    return out


def grams(data: np.ndarray):
    for at in range(0, max(len(data), 1), _BLOCK):
        yield _grams(data[at : at + _BLOCK + GRAM - 1] if at + _BLOCK < len(data) else data[at:])


def _slots(keys: np.ndarray, bits: int, n: int) -> list[np.ndarray]:
    h = mix(keys.astype(np.uint64))
    mask = np.uint64((1 << bits) - 1)
    return [((h >> np.uint64(21 * i)) & mask).astype(np.int64) for i in range(n)]


class LanguageFilter:
    """``languages`` by code point, ``table`` of slots x bytes of language bits, chance hits by language."""

    def __init__(self, languages: list[str], slots: np.ndarray):
        self.languages, self.slots = languages, slots
        n = len(languages)
        self.chance = np.array([np.mean((slots[:, i // 8] >> (i % 8)) & 1) for i in range(n)]) ** HASHES if n else np.zeros(0)

    @classmethod
    def build(cls, languages: list[str], members: dict[str, np.ndarray]) -> LanguageFilter:
        slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // 8))), np.uint8)
        for i, name in enumerate(languages):
            for at in _slots(members.get(name, np.zeros(0, np.uint32)), SLOT_BITS, HASHES):
                slots[at, i // 8] |= np.uint8(1 << (i % 8))
        return cls(languages, slots)

    def judge(self, data: np.ndarray) -> tuple[str, float]:
        hits, seen = np.zeros(len(self.languages)), 0
        for keys in grams(data):
            if not len(keys) or not self.languages:
                continue
            first, *rest = _slots(keys, SLOT_BITS, HASHES)
            found = self.slots[first]
            for at in rest:
                found &= self.slots[at]
            seen += len(keys)
            for byte in range(found.shape[1]):
                by_mask = np.bincount(found[:, byte], minlength=256)
                own = range(8 * byte, min(8 * byte + 8, len(self.languages)))
                for i in own:
                    hits[i] += by_mask[_with_bit[i % 8]].sum()
        if not self.languages:
            return UNKNOWN, 0.0
        if not seen:  # letters, but too few for an n-gram
            return self.languages[0], 0.0
        share = np.clip((hits / seen - self.chance) / np.maximum(1 - self.chance, 1e-9), 0, 1)
        best = int(np.argmax(share))
        return self.languages[best], float(share[best])


_with_bit = [np.flatnonzero((np.arange(256) >> b) & 1) for b in range(8)]


def _has_letter(data: np.ndarray) -> bool:
    if np.any((_letter_table[data] != 0) & (data < 0x80)):
        return True
    high = data[data >= 0x80]
    return bool(len(high)) and any(c.isalpha() for c in bytes(high).decode("utf-8", "ignore"))


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LanguageFilter:
    """Learn from (text, lang); rows without a language are skipped.

    Of a language with more than ``sample`` rows about so many are read, of any other all. Each task counts n-grams by
    language and sends each with its count once; only the members of the filters, a bounded number for each language, reach the driver.
    """
    rows = labelled.filter(F.col("lang").isNotNull()).select("text", "lang")
    large = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().filter(F.col("count") > sample).collect()}
    if large:
        unit = F.shiftrightunsigned(F.xxhash64("text", "lang"), 11) / F.lit(float(2**53))
        share = F.create_map(*[F.lit(x) for lang, n in large.items() for x in (lang, sample / n)])
        rows = rows.filter(unit < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0)))

    def count(batches):
        totals: dict[str, dict[int, int]] = {}
        for batch in batches:
            by_lang: dict[str, list[np.ndarray]] = {}
            for data, lang in zip(byte_rows(batch.column(0)), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).extend(grams(data))
            for lang, parts in by_lang.items():
                keys, counts = np.unique(np.concatenate(parts), return_counts=True)
                have = totals.setdefault(lang, [np.zeros(0, np.uint32), np.zeros(0, np.int64)])
                merged, at = np.unique(np.concatenate((have[0], keys)), return_inverse=True)
                totals[lang] = [merged, np.bincount(at, np.concatenate((have[1], counts)), len(merged)).astype(np.int64)]
        for lang, (keys, counts) in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(counts)], ["lang", "gram", "n"])

    counts = rows.mapInArrow(lean(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "language-grams")
    whole = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    members = counts.join(whole, "lang").filter(F.col("n") >= MIN_SHARE * F.col("total")).select("lang", "gram")
    found = members.toArrow()  # at most 1 / MIN_SHARE n-grams a language
    names, gram = np.array(found.column("lang").to_pylist(), object), found.column("gram").to_numpy().astype(np.uint32)
    by_lang = {lang: gram[names == lang] for lang in set(names)}
    return LanguageFilter.build(sorted(by_lang, key=lambda s: s.encode()), by_lang)


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """Input columns, lang_pred and score. Only the text is looked at."""
    languages, slots = model.languages, model.slots

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        known = LanguageFilter(languages, slots)
        out = [known.judge(data) if _has_letter(data) else (UNKNOWN, 0.0) for data in byte_rows(pa.array(texts, pa.string()))]
        give_back()
        return pd.DataFrame(out, columns=["lang", "score"])

    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    rows = docs.select(*keep, judge(F.col("text")).alias("_l"))
    return rows.select(*keep, F.col("_l.lang").alias("lang_pred"), F.col("_l.score").alias("score"))


def held_out(doc_id, folds: int = 5, fold: int = 0):
    """Whether the crc32 of the id as text falls on the fold; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % folds == fold


@query("op8_language")
def op8(spark, folder):
    docs = table(spark, folder, "documents")
    out = held_out(F.col("doc_id"))
    model = fit(docs.filter(~out).select("text", "lang"))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")
