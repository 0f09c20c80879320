"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from a hash of its code
point. An n-gram of letters binds them: the product of the first letter's vector
rotated twice, the second's rotated once and the third's. A text's profile is the
sum (bundle) of its n-gram vectors times the square roots of their counts, so
that a line repeated often doesn't drown the rest; a language's prototype is the
sum of its training texts' unit profiles. A text gets the language whose prototype
has the largest cosine with its profile.

How large a cosine a text of a language has depends on its number of n-grams, so
held-out texts say, for each power of two of that number, below what a text is in
none of the languages (``Profiles.floors``).

A model is one vector a language and one number a size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import prepare
from tidemark.llm.words import mix

#: Dimensions of the vectors.
DIMENSIONS = 512
#: Steps of the scale on which held-out texts' cosines are counted.
SCALE = 10_000
UNKNOWN = "und"
#: A floor is this share of the cosine that all but a hundredth of ``ENOUGH`` held-out texts or more of a size have.
FLOOR, ENOUGH = 0.5, 20

#: Letters with a place in the table of bound vectors: a blank, a to z, and the small Latin letters up to 0xFF.
_COMMON = np.array([0, *range(97, 123), *range(0xDF, 0x100)], np.int64)
_SIDE = len(_COMMON)


def letter_vectors(code: np.ndarray) -> np.ndarray:
    """+1 and -1 from a hash of each code point (a blank is 0), one row each."""
    seeds = code.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64(1 << 40)
    bits = np.unpackbits(mix(mix(seeds)).astype("<u8").view(np.uint8), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bound vectors of n-grams (three code points of 21 bits in one integer), one row each."""
    codes, at = np.unique(np.stack((grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF)), return_inverse=True)
    v, (a, b, c) = letter_vectors(codes), at.reshape(3, -1)
    return np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]


_place = np.full(_SIDE**3, -1, np.int32)
_made = np.zeros((4096, DIMENSIONS), np.int8)
_count = 0
_common_at = np.full(0x100, -1, np.int64)
_common_at[_COMMON] = np.arange(_SIDE)


def _common_place(grams: np.ndarray) -> np.ndarray:
    """Where n-grams of common letters alone have their row; -1 for others."""
    out = np.zeros(len(grams), np.int64)
    for shift in (42, 21, 0):
        code = grams >> shift & 0x1FFFFF
        at = np.where(code < 0x100, _common_at[np.minimum(code, 0xFF)], -1)
        out = np.where((out < 0) | (at < 0), -1, out * _SIDE + at)
    return out


def vectors_of(grams: np.ndarray) -> np.ndarray:
    """Bound vectors; those of common letters are made once in a worker and kept, in a table of bounded size."""
    global _made, _count
    at = _common_place(grams)
    known = at >= 0
    if len(new := np.unique(at[known][_place[at[known]] < 0])):
        while _count + len(new) > len(_made):
            _made = np.concatenate((_made, np.zeros_like(_made)))
        parts = [_COMMON[new // _SIDE**k % _SIDE] for k in (2, 1, 0)]
        _made[_count : _count + len(new)] = gram_vectors(parts[0] << 42 | parts[1] << 21 | parts[2])
        _place[new] = np.arange(_count, _count + len(new))
        _count += len(new)
    out = np.empty((len(grams), DIMENSIONS), np.float32)
    out[known] = _made[_place[at[known]]]
    if not known.all():
        out[~known] = gram_vectors(grams[~known])
    return out


def _letter(c: int) -> int:
    """Small form of a letter, 0 for what is no letter."""
    x = chr(c).lower()[:1]
    return ord(x) if x.isalpha() else 0


_LOW = np.array([_letter(c) for c in range(0x600)], np.int64)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter trigrams of a whole text with their counts; runs of other characters are one blank (0)."""
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    s = _LOW[np.minimum(code, len(_LOW) - 1)]
    if (high := code >= len(_LOW)).any():
        codes, at = np.unique(code[high], return_inverse=True)
        s[high] = np.array([_letter(int(c)) for c in codes], np.int64)[at]
    s = s[(s != 0) | (np.concatenate(([1], s[:-1])) != 0)]
    if not s.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.concatenate((s[:0] if s[0] == 0 else [0], s, s[:0] if s[-1] == 0 else [0])).astype(np.int64)
    grams = s[:-2] << 42 | s[1:-1] << 21 | s[2:]
    at = _common_place(grams)
    if (at >= 0).all():  # counted by place in the table
        count = np.bincount(at) if len(at) > 20_000 else None
        if count is None:
            at = np.sort(at.astype(np.int32))
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            found, count = at[first].astype(np.int64), np.diff(np.append(first, len(at)))
        else:
            found = np.flatnonzero(count)
            count = count[found]
        return _COMMON[found // _SIDE**2] << 42 | _COMMON[found // _SIDE % _SIDE] << 21 | _COMMON[found % _SIDE], count
    return np.unique(grams, return_counts=True)


def size_class(n: int) -> int:
    """Texts are of a size if their numbers of distinct n-grams have as many binary digits."""
    return int(n).bit_length()


@dataclass
class Profiles:
    """Languages, their unit prototypes, and for each size the cosine below which a text is in none of them."""

    languages: list[str]
    prototypes: np.ndarray  # (languages, DIMENSIONS), float32
    floors: dict[int, float] = field(default_factory=dict)

    @classmethod
    def from_sums(cls, sums: dict[str, np.ndarray]) -> Profiles:
        """``sums``: language -> bundled vector."""
        languages = sorted(sums)
        proto = np.array([sums[name] / (np.linalg.norm(sums[name]) or 1.0) for name in languages]).reshape(len(languages), DIMENSIONS)
        return cls(languages, proto.astype(np.float32))

    def look(self, text: str | None) -> tuple[str, float, int]:
        """Language, cosine (0 to 1) and number of distinct n-grams of a whole text; ``und``, 0 and 0 without a letter."""
        if not self.languages or not text or not has_letter(text):
            return UNKNOWN, 0.0, 0
        grams, count = grams_of(text)
        profile = np.zeros(DIMENSIONS, np.float32)
        for at in range(0, len(grams), 8192):
            profile += np.sqrt(count[at : at + 8192]).astype(np.float32) @ vectors_of(grams[at : at + 8192])
        dot, size = self.prototypes @ profile, float(np.linalg.norm(profile))
        best = int(np.argmax(dot))
        return self.languages[best], float(min(1.0, max(0.0, dot[best] / size))) if size else 0.0, len(grams)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.look(text)[:2]

    def accepts(self, text: str | None) -> bool:
        """Whether the text is in one of the languages: it has a letter, and is no less like its language than held-out texts of its size are."""
        lang, score, n = self.look(text)
        known = [k for k in self.floors if k <= size_class(n)]  # longer texts are the more like their language, not the less
        return lang != UNKNOWN and score >= (self.floors[max(known)] if known else 0.0)


def held_out(key: str):
    """Documents kept from training: CRC-32 of the key as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _labelled(docs: DataFrame, out: bool, key: str, text: str, lang: str) -> DataFrame:
    """(lang, text) of all labelled documents that are held out, or of all others."""
    rows = docs.where(F.col(lang).isNotNull() & (held_out(key) == out))
    return rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))


def with_floors(profiles: Profiles, docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """The same profiles with floors from all held-out labelled documents that get their own label; sizes with few of them have no floor.

    Tasks count cosines by their place on a scale of ``SCALE`` steps, so a size has that many rows at most, however many texts there are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[int, int]] = Counter()
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, score, n = shared.value.look(t)
                if found == name:
                    seen[size_class(n), int(score * SCALE)] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["size", "step", "n"])

    steps = _labelled(docs, True, key, text, lang).mapInArrow(run, "size int, step int, n long").groupBy("size", "step").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("size")
    upto = steps.select("size", "step", F.sum("n").over(w.orderBy("step")).alias("upto"), F.sum("n").over(w).alias("all"))
    # the step of the text with a hundredth of the others of its size below it
    least = upto.where((F.col("all") >= ENOUGH) & (F.col("upto") > (F.col("all") - 1) * 0.01)).groupBy("size").agg(F.min("step").alias("least"))
    return Profiles(profiles.languages, profiles.prototypes, {r.size: FLOOR * r.least / SCALE for r in least.collect()})  # a row for each power of two


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from all labelled documents that aren't held out.

    Tasks bundle their documents' vectors by language, Spark adds those of
    tasks up, and ``DIMENSIONS`` numbers a language come to the driver.
    """
    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grams, count = grams_of(t)
                if len(grams):
                    weight = np.sqrt(count)
                    whole = np.rint(weight * (1e6 / np.linalg.norm(weight)))  # whole numbers: sums don't depend on their order
                    for at in range(0, len(grams), 4096):
                        total[name] = total.get(name, 0.0) + whole[at : at + 4096] @ vectors_of(grams[at : at + 4096]).astype(np.float64)
        n = DIMENSIONS
        for name, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(v.astype(np.int64))], names=["lang", "dimension", "n"])

    sums = _labelled(docs, False, key, text, lang).mapInArrow(bundle, "lang string, dimension int, n long").groupBy("lang", "dimension").agg(F.sum("n").alias("n"))
    out: dict[str, np.ndarray] = {}
    for name, at, x in sums.collect():  # languages x DIMENSIONS rows
        out.setdefault(name, np.zeros(DIMENSIONS))[at] = x
    return Profiles.from_sums(out)


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score after its own columns (columns of these names are replaced).

    A null text, or one without a letter, is ``und`` with score 0. Ties go to the
    first language by name. Whole texts count, of any length. Rows that repeat stay as many; an empty table stays empty.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    out = docs.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    arrow, at = to_arrow_schema(out), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in got], pa.string()), pa.array([y for _, y in got], pa.float64())], schema=arrow)

    return docs.mapInArrow(run, out)


def in_some_language(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns whatever their names, whose text is in one of the profiles' languages (see ``Profiles.accepts``)."""
    prepare(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(profiles), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([shared.value.accepts(t) for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
