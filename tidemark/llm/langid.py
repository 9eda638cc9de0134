"""Language identification by bit-sliced Bloom filters of character n-grams.

Each slot of one table holds a bitmask of languages (as many words of 64 as they need); an n-gram's slots, and-ed, give
every language that holds it at once. A document's language is the one with most n-grams, once the expected false positives are taken off.
"""

from __future__ import annotations

import math
import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import held_out, in_slices

SIZES = (2, 3, 4)
#: Characters that are worked on at once; longer texts span several blocks.
BLOCK = 1 << 19
#: Characters of shorter texts that are measured at once.
TOGETHER = 1 << 17
#: Languages that one filter can hold; more raise.
MOST_LANGUAGES = 4096
_KINDS: list[np.ndarray] = []


def _kinds() -> list[np.ndarray]:
    """For each code point whether it's a letter or a mark on one, and whether it's a letter."""
    if not _KINDS:
        kind = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        _KINDS[:] = np.array([k in "LM" for k in kind]), np.array([k == "L" for k in kind])
    return _KINDS


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _blocks(texts: list[str | None], together: int = BLOCK):
    """(letters as code points with 0 for all else, document of each) in blocks; a text's parts overlap by three characters."""
    parts: list[str] = []
    owners: list[tuple[int, int]] = []
    held = 0
    over = max(SIZES) - 1

    def out():
        s = "".join(parts)
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        return c * _kinds()[0][c], np.repeat([o for o, _ in owners], [n for _, n in owners])

    for k, t in enumerate(texts):
        low = (t or "").lower()
        for at in range(0, len(low), BLOCK):
            piece = "\0" + low[at - over if at else 0 : at + BLOCK] + "\0" if not at or at + BLOCK >= len(low) else low[at - over : at + BLOCK]
            parts.append(piece)
            owners.append((k, len(piece)))
            held += len(piece)
            if held >= together:
                yield out()
                parts, owners, held = [], [], 0
    if parts:
        yield out()


def _grams(c: np.ndarray, doc: np.ndarray):
    """(hash, document) of the n-grams inside words; one of three or four letters may begin or end at a word's border."""
    for n in SIZES:
        if len(c) < n:
            continue
        at = [c[k : len(c) - n + 1 + k] for k in range(n)]
        ok = doc[: len(c) - n + 1] == doc[n - 1 :]
        for k in range(n) if n == 2 else range(1, n - 1):
            ok &= at[k] != 0
        if n > 2:
            ok &= (at[0] != 0) | (at[-1] != 0)
        h = np.full(int(ok.sum()), n, np.uint64)
        for x in at:
            h = h * np.uint64(0x100000001B3) + x[ok]
        yield _mix(h), doc[: len(c) - n + 1][ok]


@dataclass(frozen=True)
class LanguageFilter:
    """Slots of language bits. share: of each language's bit, the part of the slots that hold it."""

    languages: tuple[str, ...]
    slots: np.ndarray
    hashes: int
    share: np.ndarray

    @classmethod
    def build(cls, languages: tuple[str, ...], grams: dict[str, np.ndarray], hashes: int = 3, bits_each: int = 24) -> LanguageFilter:
        most = max([len(g) for g in grams.values()], default=1)
        size = 1 << max(10, int(np.ceil(np.log2(max(1, most) * bits_each / 4))))
        slots = np.zeros((size, -(-len(languages) // 64) or 1), np.uint64)
        for k, lang in enumerate(languages):
            for at in cls._places(grams[lang], size, hashes):
                np.bitwise_or.at(slots[:, k // 64], at, np.uint64(1 << k % 64))
        share = np.array([cls.has(slots, k).mean() for k in range(len(languages))])
        return cls(languages, slots, hashes, share)

    @staticmethod
    def has(masks: np.ndarray, k: int) -> np.ndarray:
        """Which of the bitmasks hold the language k."""
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1) != 0

    @staticmethod
    def _places(h: np.ndarray, size: int, hashes: int):
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(hashes):
            yield ((h + np.uint64(k) * step) & np.uint64(size - 1)).astype(np.int64)

    def members(self, h: np.ndarray) -> np.ndarray:
        """The bitmask of the languages that hold each n-gram (false positives included)."""
        mask = np.full((len(h), self.slots.shape[1]), ~np.uint64(0))
        for at in self._places(h, len(self.slots), self.hashes):
            mask &= self.slots[at]
        return mask

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language and a score of 0 to 1 for each text; und, 0 for a null or a text without letters."""
        return self.measure(texts)[:2]

    def measure(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """What predict gives, and the evidence for the language: the share of the text's n-grams that it holds, without the
        expected false positives, and how many standard deviations of these that is. N-grams of all languages don't count."""
        hits, total, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts)), np.zeros(len(texts))
        n = len(self.languages)
        every = np.array([(1 << max(0, min(64, n - 64 * w))) - 1 for w in range(self.slots.shape[1])], np.uint64) if n > 1 else ~np.uint64(0)
        for c, doc in _blocks(texts, TOGETHER):
            letters += np.bincount(doc, weights=_kinds()[1][c], minlength=len(texts))
            for h, d in _grams(c, doc):
                mask = self.members(h)
                tells = (mask != every).any(1)  # what all languages share tells nothing
                mask, d = mask[tells], d[tells]
                total += np.bincount(d, minlength=len(texts))
                for k in range(n):
                    hits[:, k] += np.bincount(d[self.has(mask, k)], minlength=len(texts))
        wrong = self.share**self.hashes
        true = np.clip((hits - total[:, None] * wrong) / (1 - wrong + 1e-12), 0, None)
        best = true.argmax(1)  # the first of equals: languages are in order of their documents' number
        first = true[np.arange(len(texts)), best]
        true[np.arange(len(texts)), best] = -1
        second = np.clip(true.max(1), 0, None) if len(self.languages) > 1 else np.zeros(len(texts))
        score = np.where(first + second > 0, first / np.maximum(first + second, 1e-12), 0.0)
        p = wrong[best]
        share = first / np.maximum(total, 1)
        deviations = first * (1 - p) / np.sqrt(np.maximum(total * p * (1 - p), 1e-12))
        return ["und" if not n else self.languages[k] for n, k in zip(letters, best)], np.where(letters > 0, score, 0.0), share, np.where(total > 0, deviations, 0.0)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 1500, most_grams: int = 12000) -> LanguageFilter:
    """The filter of a bounded sample of labelled rows: of each language the most_docs documents with the smallest id hashes.

    Rows held out, without text or without lang teach nothing; of an id that repeats one text counts. All languages are
    learned, as many as MOST_LANGUAGES; more raise. The n-grams of the sample are counted in Spark; a language is modelled by
    its most_grams commonest, and the driver sees these only. Without a language to learn every text is und.
    """
    rows = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    ids = rows.select("i", "l").distinct()
    sizes = ids.groupBy("l").count().orderBy(F.desc("count"), "l").limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    names = tuple(r["l"] for r in sizes)
    if not names:
        return LanguageFilter((), np.zeros((1024, 1), np.uint64), 3, np.zeros(0))
    # a hash bound leaves a few more than most_docs of each language, however large it is; the window takes them from these
    span = 1 << 40
    wanted = most_docs + 6 * math.sqrt(most_docs) + 20
    bounds = docs.sparkSession.createDataFrame([(r["l"], min(span, int(wanted / r["count"] * span))) for r in sizes], "l string, bound long")
    near = ids.withColumn("x", F.shiftrightunsigned(F.xxhash64("i"), 24)).join(F.broadcast(bounds), "l").where("x <= bound")
    order = Window.partitionBy("l").orderBy("x", "i")
    chosen = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most_docs).select("i", "l")
    sample = rows.join(F.broadcast(chosen), ["i", "l"], "left_semi").groupBy("i", "l").agg(F.min("t").alias("t"))

    def count(batches):
        for b in batches:
            texts, labels = b.column(0).to_pylist(), np.array([names.index(x) for x in b.column(1).to_pylist()], np.int64)
            for c, doc in _blocks(texts):
                for h, d in _grams(c, doc):
                    for k in np.unique(labels[d]) if len(d) else ():
                        g, n = np.unique(h[labels[d] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g.view(np.int64)), pa.array(n)], ["k", "g", "n"])

    grams = sample.select("t", "l").mapInArrow(count, "k long, g long, n long").groupBy("k", "g").agg(F.sum("n").alias("n"))
    top = grams.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("n"), "g"))).where(F.col("r") <= most_grams).select("k", "g").toArrow()
    k, g = top.column("k").to_numpy(), top.column("g").to_numpy().view(np.uint64)
    return LanguageFilter.build(names, {name: g[k == i] for i, name in enumerate(names)})


def usual_shares(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(lang, share): of each predicted language the median share of known n-grams over all held-out documents."""
    held = docs.where(held_out(id_col) & F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("t"))
    found = identify(held, model, "t", "lang", "score", ("part", "deviations"))
    return found.where("score > 0").groupBy("lang").agg(F.percentile_approx("part", 0.5, 10000).alias("share"))


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "lang_score", evidence_cols: tuple[str, str] | None = None) -> DataFrame:
    """docs with two more columns: the predicted language and its score. Extra columns pass through; clashing names raise.

    Null texts and texts without a letter (marks alone aren't letters) are und with score 0. Of languages that fit equally
    the one with more documents is taken. Repeated rows and empty tables stay as they are; whole texts are read in blocks.
    evidence_cols names two more, if wanted: the share of known n-grams and its standard deviations over chance.
    """
    for c in (lang_col, score_col, *(evidence_cols or ())):
        if c in docs.columns:
            raise ValueError(f"docs has a column {c} already")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()
    at = docs.columns.index(text_col)

    def run(batches):
        for b in in_slices(batches):
            if shared.value.languages:
                lang, score, *evidence = shared.value.measure(b.column(at).to_pylist())
            else:
                lang, score, *evidence = ["und"] * b.num_rows, *np.zeros((3, b.num_rows))
            more = [pa.array(x) for x in evidence] if evidence_cols else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), *more], [*b.schema.names, lang_col, score_col, *(evidence_cols or ())])

    return docs.mapInArrow(run, docs.select("*", F.lit("").alias(lang_col), F.lit(0.0).alias(score_col), *(F.lit(0.0).alias(c) for c in evidence_cols or ())).schema)
