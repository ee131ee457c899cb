"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from a hash of the letter. A trigram is bound as the product of its
letters' vectors, permuted (rolled) by 2, 1 and 0 places; a text bundles, that is adds, the vectors of its trigrams, and a
language those of all its learned texts. The language with the largest cosine to the text is the prediction. Other characters
than letters count as one blank between words.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

_SLICE = 1 << 20


@lru_cache(1 << 14)
def letter_vector(code: int, dimension: int) -> np.ndarray:
    return np.random.default_rng((91, code)).integers(0, 2, dimension).astype(np.float32) * 2 - 1


@lru_cache
def _letters() -> np.ndarray:
    """Whether each code point below 0x20000 is a letter, those above being taken as letters too (ideographs)."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x20000)] + [True])


def _ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and the rank of each value; by a table where the values are small, which is faster than sorting."""
    top = int(values.max(initial=0))
    if top >= 1 << 22:
        return np.unique(values, return_inverse=True)
    present = np.zeros(top + 1, bool)
    present[values] = True
    return np.flatnonzero(present), (np.cumsum(present, dtype=np.int32) - 1)[values]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alphabet (codes, 0 is the blank), trigrams of alphabet positions (n x 3), document of each, and whether a document has letters."""
    lowered = ["\0" + (t or "").lower() + "\0" for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t) for t in lowered])
    doc = np.repeat(np.arange(len(texts)), lengths)
    letter = _letters()[np.minimum(codes, 0x20000)]
    codes = np.where(letter, codes, 0)
    keep = letter | np.roll(letter, 1)  # of a run of others, the first is the blank
    keep[np.cumsum(lengths) - lengths] = True
    codes, doc = codes[keep], doc[keep]
    alphabet, at = _ranked(codes)
    same = doc[2:] == doc[:-2]
    full = same & (codes[1:-1] != 0)
    grams = np.column_stack((at[:-2], at[1:-1], at[2:]))[full]
    has = np.zeros(len(texts), bool)
    has[doc[codes != 0]] = True
    return alphabet, grams, doc[:-2][full], has


def bundled(alphabet: np.ndarray, grams: np.ndarray, group: np.ndarray, n_groups: int, dimension: int) -> np.ndarray:
    """The sum of the trigram vectors of each group."""
    if not len(grams):
        return np.zeros((n_groups, dimension), np.float64)
    size = len(alphabet)
    distinct, at = _ranked((grams[:, 0].astype(np.int64) * size + grams[:, 1]) * size + grams[:, 2])
    counts = np.bincount(group * len(distinct) + at, minlength=n_groups * len(distinct)).reshape(n_groups, -1).astype(np.float32)
    letters = np.stack([letter_vector(int(c), dimension) for c in alphabet])
    once, twice = np.roll(letters, 1, 1), np.roll(letters, 2, 1)
    out = np.zeros((n_groups, dimension), np.float64)
    for k in range(0, len(distinct), 4096):
        d = distinct[k : k + 4096]
        out += counts[:, k : k + 4096] @ (twice[d // (size * size)] * once[d // size % size] * letters[d % size])
    return out


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str | None]]]:
    texts = [t.as_py() for t in batch.column("text")]
    at = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= _SLICE or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, held = i + 1, 0


def profiles(docs: DataFrame, learn: Column, dimension: int) -> dict[str, np.ndarray]:
    """The bundle of every language over all documents where ``learn`` holds; sums of whole numbers, so the order does not matter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in _parts(batch):
                names, group = np.unique(langs[at : at + len(texts)], return_inverse=True)
                alphabet, grams, doc, _ = trigrams(texts)
                for name, row in zip(names.tolist(), bundled(alphabet, grams, group[doc], len(names), dimension)):
                    sums[name] = sums.get(name, 0) + np.rint(row).astype(np.int64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * dimension), pa.array(np.arange(dimension)), pa.array(row)], ["lang", "at", "total"]
            )

    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    summed = rows.mapInArrow(run, "lang string, at long, total long").groupBy("lang", "at").agg(F.sum("total").alias("total"))
    out: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages x dimension numbers
        out.setdefault(row.lang, np.zeros(dimension))[row.at] = row.total
    return out


def languages(docs: DataFrame, learn: Column, dimension: int = 1024) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (doc_id, text, lang): the learned language nearest to the whole text.

    ``learn`` says which rows the profiles may see; rows with a null lang or text are not learned from. ``score`` is the cosine,
    0 if negative. Texts that are null or have no letter are ``und`` with score 0, and so is everything if nothing was learned.
    Ties go to the first language by name. Repeated rows get equal results; null ids are kept; no rows give no rows.
    """
    learned = {k: v for k, v in profiles(docs, learn, dimension).items() if v.any()}
    names = sorted(learned)
    matrix = np.array([learned[n] / np.linalg.norm(learned[n]) for n in names]).reshape(len(names), dimension)
    shared = docs.sparkSession.sparkContext.broadcast((names, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        for batch in batches:
            for at, texts in _parts(batch):
                alphabet, grams, doc, has = trigrams(texts)
                vectors = bundled(alphabet, grams, doc, len(texts), dimension)
                if names:
                    cosines = vectors @ matrix.T / np.maximum(np.linalg.norm(vectors, axis=1), 1e-12)[:, None]
                    best = cosines.argmax(1)
                    score = np.where(has, np.clip(cosines[np.arange(len(texts)), best], 0, 1), 0.0)
                    found = [names[b] if h else "und" for b, h in zip(best, has)]
                else:
                    score, found = np.zeros(len(texts)), ["und"] * len(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), pa.array(found, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
