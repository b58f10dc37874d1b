"""Language identification with string kernels.

The blended-spectrum presence kernel of two texts is the number of distinct
character n-grams (n = 1, 2, 3) that both have, divided by the geometric mean of
their own numbers. Nyström landmarks (sampled texts, as many of each language)
make it a finite feature map, and one-versus-rest kernel ridge regression on
that map gives one coefficient per landmark and language. A batch of texts is
scored by two matrix products: presence by landmarks' n-grams, and kernel values
by coefficients.

Characters are lower-cased; all that are neither letters nor combining marks
count as one separator. N-grams of the sample's most frequent letters have small
numbers and are marked in an array of flags; n-grams with any other letter have
numbers made of its code point and are kept sorted ("wide"), so no letter of any
script is lost. Only n-grams of the landmarks enter the first product (wide ones
are looked up instead), and a text's own number of n-grams its norm, so kernel
values are exact. Landmarks go through it in tiles, each with its own n-grams.

Every language of the rows to learn from is learned and has a landmark. The fit
needs sums over the sample only (kernel values by kernel values, and by
language); tasks form them, with kernel values rounded to 1/65536, so they are
whole numbers and add up to the same bits in any order.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablelens.llm.common import pick, slices, sql_type, stage
from tablelens.llm.samples import id_remainder

#: Bound on the sample: texts of each language. Landmarks in all, or one of each language if these are more.
PER_LANGUAGE, LANDMARKS = 300, 128
#: Landmarks in one matrix product, and the whole numbers that kernel values have in sums.
TILE, _UNIT = 128, 1 << 16
RIDGE = 1e-2
#: Letters whose n-grams have small numbers (below about a million); the others' n-grams have large ones.
ALPHABET = 95
UNDETERMINED = "und"
#: Texts in one matrix product, and characters whose n-grams are marked at once.
BATCH, _CHUNK = 128, 1 << 20


@cache
def _other_letters() -> np.ndarray:
    """A flag for each code point that is a letter or a combining mark."""
    points = map(chr, range(sys.maxunicode + 1))
    return np.array([c.isalpha() or unicodedata.category(c)[0] == "M" for c in points])


def letter_table(letters: str) -> np.ndarray:
    """Number of each code point: 1.. for ``letters``, above those for other letters, 0 for the rest."""
    points = np.arange(sys.maxunicode + 1)
    table = np.where(_other_letters(), points + len(letters) + 1, 0)
    for i, c in enumerate(letters, 1):
        table[ord(c)] = i
    return table


class Spectrum:
    """Distinct n-grams (n = 1, 2, 3) of texts, as numbers.

    N-grams of ``letters`` and separators have numbers below ``small``; those with another letter from there on.
    """

    def __init__(self, letters: str):
        self._table = letter_table(letters)
        self._base = len(letters) + 1
        self.small = self._base + self._base**2 + self._base**3
        self._seen = np.zeros(self.small, dtype=bool)

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """A flag for each small number, valid until the next call, and the wide n-grams' numbers, ascending."""
        seen, b, wide = self._seen, self._base, np.empty(0, dtype=np.int64)
        seen[:] = False
        code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at in range(0, len(code), _CHUNK):
            c = self._table[code[at : at + _CHUNK + 2]]
            far = c >= b
            if far.any():
                wide = np.union1d(wide, self._wide(c, far))
                one, two, three = ~far, ~(far[:-1] | far[1:]), ~(far[:-2] | far[1:-1] | far[2:])
            else:
                one = two = three = slice(None)
            seen[c[one]] = True
            pair = c[:-1] * b + c[1:]
            seen[pair[two] + b] = True
            seen[(pair[:-1] * b + c[2:])[three] + (b + b * b)] = True
        return seen, wide

    def _wide(self, c: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Numbers of the n-grams that hold a letter beyond the small ones (below 2**61)."""
        b = self._base + sys.maxunicode + 1
        pair = c[:-1] * b + c[1:]
        two, three = far[:-1] | far[1:], far[:-2] | far[1:-1] | far[2:]
        parts = (c[far], pair[two] + b, (pair[:-1] * b + c[2:])[three] + (b + b * b))
        return np.concatenate(parts) + self.small

    def mark(self, text: str) -> np.ndarray:
        """A flag for each small n-gram number, valid until the next call."""
        return self.read(text)[0]

    def grams(self, text: str) -> np.ndarray:
        seen, wide = self.read(text)
        return np.concatenate([np.flatnonzero(seen), wide])


class Shared:
    """Which of some ascending sets of n-grams hold each n-gram of another."""

    def __init__(self, sets: list[np.ndarray]):
        every = np.concatenate([*sets, np.empty(0, dtype=np.int64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        self._owners = owner[order].astype(np.int32)
        self._grams, starts = np.unique(every[order], return_index=True)
        self._starts = np.append(starts, len(every))
        self._sets = len(sets)

    def count(self, grams: np.ndarray) -> np.ndarray:
        """Number of ``grams`` (distinct) in each set."""
        if not len(grams) or not len(self._grams):
            return np.zeros(self._sets)
        at = np.minimum(np.searchsorted(self._grams, grams), len(self._grams) - 1)
        at = at[self._grams[at] == grams]
        size = self._starts[at + 1] - self._starts[at]
        entry = np.arange(size.sum()) + np.repeat(self._starts[at] - (np.cumsum(size) - size), size)
        return np.bincount(self._owners[entry], minlength=self._sets).astype(float)


@dataclass(frozen=True)
class Tile:
    """Some landmarks as a matrix of their small n-grams."""

    vocabulary: np.ndarray  # small numbers of the landmarks' n-grams, ascending
    presence: np.ndarray  # vocabulary x landmarks, 0 or 1, over the landmark's norm
    wide: Shared  # wide n-grams of the landmarks
    norms: np.ndarray  # root of each landmark's number of n-grams


@dataclass(frozen=True)
class Landmarks:
    letters: str
    tiles: list[Tile]

    def kernel(self):
        """A function from texts to their kernel values, texts x landmarks."""
        spectrum = Spectrum(self.letters)

        def values(texts: list[str]) -> np.ndarray:
            x = [np.empty((len(texts), len(t.vocabulary)), dtype=np.float32) for t in self.tiles]
            far = [np.zeros((len(texts), len(t.norms)), dtype=np.float32) for t in self.tiles]
            size = np.empty(len(texts))
            for i, text in enumerate(texts):
                seen, wide = spectrum.read(text)
                size[i] = np.count_nonzero(seen) + len(wide)
                for k, t in enumerate(self.tiles):
                    x[k][i] = seen[t.vocabulary]
                    if len(wide):
                        far[k][i] = t.wide.count(wide) / t.norms
            products = [x[k] @ t.presence + far[k] for k, t in enumerate(self.tiles)]
            return np.hstack(products) / np.sqrt(np.maximum(size, 1))[:, None]

        return values


@dataclass(frozen=True)
class Model:
    landmarks: Landmarks
    languages: tuple[str, ...]
    coefficients: np.ndarray  # landmarks x languages

    def scorer(self):
        """A function from texts to ``(languages' numbers, scores)``; scores lie in 0..1."""
        kernel = self.landmarks.kernel()

        def score(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
            values = kernel(texts) @ self.coefficients
            best = values.argmax(axis=1)
            top = values[np.arange(len(texts)), best]
            return best, np.clip((top + 1) / 2, 0, 1)

        return score


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def training_sample(docs: DataFrame, held_out_of: int, held_out: int, per_language: int) -> DataFrame:
    """``(text, lang, nth)``: up to ``per_language`` non-empty texts of each language, staged.

    Each language's rows with the smallest hashes of id and text, counted from
    1. The first pass ranks hashes alone and finds the last one that a language
    takes; the second takes the texts up to it. Rows are ranked, not ids, so an
    id may have any number of rows, in any language.
    """
    learn = (id_remainder(F.col("doc_id"), held_out_of) != held_out) & F.col("lang").isNotNull() & (F.length("text") > 0)
    rows = docs.where(learn).select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("key"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key"))

    def first(some: DataFrame) -> DataFrame:
        return some.withColumn("nth", nth).where(F.col("nth") <= per_language)

    last = first(rows.select("lang", "key")).groupBy("lang").agg(F.max("key").alias("last"))
    # One row for each language, as many as the model has columns.
    picked = rows.join(F.broadcast(last), "lang").where("key <= last").drop("last")
    return stage(first(picked).select("text", "lang", "nth"), "languages")


def _letters(sample: DataFrame, size: int) -> str:
    """The most frequent letters of the sample's lower-cased texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in slices(batches):
            for t in b.column(0).to_pylist():
                counts.update(t.lower())
        some = [c for c in counts if c.isalpha()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([counts[c] for c in some], pa.int64())], ["c", "n"])

    counts = sample.mapInArrow(run, "c string, n bigint").groupBy("c").agg(F.sum("n").alias("n"))
    return "".join(r["c"] for r in counts.orderBy(F.desc("n"), "c").limit(size).collect())


def _landmarks(sample: DataFrame, letters: str, count: int) -> tuple[Landmarks, np.ndarray]:
    """The first text of each language, then the second of each, ... up to ``count``, and their own kernel values.

    Only their distinct n-grams come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spectrum = Spectrum(letters)
        for b in slices(batches):
            grams = [spectrum.grams(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.list_(pa.int64())), *b.columns[1:]], ["grams", "lang", "nth"])

    firsts = sample.orderBy("nth", "lang").limit(count)
    rows = firsts.mapInArrow(run, f"grams array<bigint>, lang {sql_type(sample, 'lang')}, nth int").collect()
    grams = [np.array(r["grams"]) for r in sorted(rows, key=lambda r: (r["nth"], r["lang"]))]
    small, tiles = Spectrum(letters).small, []
    for at in range(0, len(grams), TILE):
        some = grams[at : at + TILE]
        vocabulary = np.unique(np.concatenate(some))
        vocabulary = vocabulary[vocabulary < small]
        norms = np.sqrt([len(g) for g in some], dtype=np.float32)
        presence = np.zeros((len(vocabulary), len(some)), dtype=np.float32)
        for j, g in enumerate(some):
            presence[np.searchsorted(vocabulary, g[g < small]), j] = 1
        tiles.append(Tile(vocabulary, presence / norms, Shared([g[g >= small] for g in some]), norms))
    norms, every = np.concatenate([t.norms for t in tiles]).astype(float), Shared(grams)
    return Landmarks(letters, tiles), np.array([every.count(g) for g in grams]) / norms / norms[:, None]


def _sums(sample: DataFrame, landmarks: Landmarks, names: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over the sample: kernel values by kernel values, kernel values by language, and rows by language."""
    number = {n: i for i, n in enumerate(names)}
    marks = sum(len(t.norms) for t in landmarks.tiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = landmarks.kernel()
        products, sums, counts = np.zeros((marks, marks)), np.zeros((len(names), marks)), np.zeros(len(names))
        for b in slices(batches, BATCH):
            values = np.rint(kernel(b.column(0).to_pylist()).astype(float) * _UNIT)  # sums stay below 2^53 for two million rows
            language = np.array([number[x] for x in b.column(1).to_pylist()])
            products += values.T @ values
            np.add.at(sums, language, values)
            counts += np.bincount(language, minlength=len(names))
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (products, sums, counts)], ["p", "s", "c"])

    total = [np.zeros(marks * marks), np.zeros(len(names) * marks), np.zeros(len(names))]
    for row in sample.select("text", "lang").mapInArrow(run, "p binary, s binary, c binary").toLocalIterator():
        for t, x in zip(total, row, strict=True):
            t += np.frombuffer(x)
    return total[0].reshape(marks, marks) / _UNIT**2, total[1].reshape(-1, marks) / _UNIT, total[2]


def fit_languages(
    docs: DataFrame,
    held_out_of: int = 3,
    held_out: int = 1,
    per_language: int = PER_LANGUAGE,
    landmarks: int = LANDMARKS,
    ridge: float = RIDGE,
) -> Model | None:
    """Fit on ``docs`` (``doc_id, text, lang``); None if there is nothing to learn from.

    Learns from documents with a language whose id's crc32 (as text) leaves
    another remainder than ``held_out``. Every language with a non-empty text
    among them is learned; there are ``landmarks`` landmarks, or one of each
    language if these are more. The model grows with the number of languages,
    not with texts or rows.
    """
    sample = training_sample(docs, held_out_of, held_out, per_language)
    letters = _letters(sample, ALPHABET)
    if not letters:
        return None
    names = sorted(r["lang"] for r in sample.where("nth = 1").select("lang").collect())
    chosen, own = _landmarks(sample, letters, max(landmarks, len(names)))
    products, sums, counts = _sums(sample, chosen, names)
    values, vectors = np.linalg.eigh(own)
    sound = values > 1e-8 * values.max()
    whiten = vectors[:, sound] / np.sqrt(values[sound])
    inner = whiten.T @ products @ whiten
    outer = whiten.T @ (2 * sums - sums.sum(axis=0)).T  # 1 for a language's own rows, -1 for the others
    weights = np.linalg.solve(inner + ridge * counts.sum() * np.eye(len(inner)) / len(own), outer)
    return Model(chosen, tuple(names), (whiten @ weights).astype(np.float32))


def identify_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out_of: int = 3,
    held_out: int = 1,
    **settings,
) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row's whole text.

    ``lang_pred`` is ``und`` with score 0 for a null text or one without
    letters, and for all texts if no language could be learned. Null ids count
    as held out; ids may repeat; an empty table gives an empty result. The
    model's size is bounded by the sample's and goes with the task.
    """
    d = pick(docs, doc_id=id_col, text=text_col, lang=lang_col)
    model = fit_languages(d, held_out_of, held_out, **settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer() if model is not None else None
        for b in slices(batches, BATCH):
            texts = b.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if score is not None and has_letter(t)]
            lang, value = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            if known:
                best, top = score([texts[i] for i in known])
                for i, k, v in zip(known, best.tolist(), top.tolist(), strict=True):
                    lang[i], value[i] = model.languages[k], v
            made = [pa.array(lang, pa.string()), pa.array(value, pa.float64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], ["doc_id", "lang_pred", "score"])

    kinds = f"doc_id {sql_type(d, 'doc_id')}, lang_pred string, score double"
    scored = d.select("doc_id", "text").mapInArrow(run, kinds)
    out = F.coalesce(id_remainder(F.col("doc_id"), held_out_of) == held_out, F.lit(True))
    return scored.select("doc_id", out.alias("held_out"), "lang_pred", "score")
