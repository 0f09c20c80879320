"""Token counts by heap-and-linked-list byte-pair merging.

A pre-token starts as one symbol a byte. A heap holds the adjacent pairs by
(rank, place), a linked list the symbols that are left; the lowest pair is
popped and merged until no ranked pair is left. The count is the initial
symbols minus the merges: no id is looked up or emitted.

Pre-tokens repeat, so each worker keeps those it has counted in two generations
of ``CACHE`` entries; when the younger is full the older goes. Memory is bounded by that and by one batch.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts, prepare
from tidemark.llm.words import word_pipeline

#: Entries in a worker's table of counted words.
CACHE = 400_000
_WORDS = re.compile(r"[^ \n\t\r]+").findall
#: White space as Unicode defines it (the library's ``\s``).
_SPACE = r"\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairCounter:
    """Counts of one ``tokenizers`` BPE file of the kind that ``word_pipeline`` knows; other files are refused."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pattern = word_pipeline(spec)
        if pattern is None:
            raise ValueError(f"{path}: this file's normaliser, pre-tokeniser or model isn't supported")
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.symbols = byte_symbols()
        self.split = regex.compile(pattern.replace(r"\s", _SPACE)).findall
        self.found = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def merged(self, piece: str) -> int:
        """Symbols left of one pre-token once no adjacent pair has a rank."""
        sym = [self.symbols[b] for b in piece.encode("utf-8", "surrogatepass")]
        n = len(sym)
        if not n:
            return 0
        sym[-1] += self.end
        rank, left = self.rank.get, n
        heap = [(r, i) for i in range(n - 1) if (r := rank((sym[i], sym[i + 1]))) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if sym[i] is None or j >= n or rank((sym[i], sym[j])) != r:
                continue  # one side was merged since this pair went in
            sym[i] += sym[j]
            sym[j] = None
            left -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank((sym[i], sym[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (k := before[i]) >= 0 and (r := rank((sym[k], sym[i]))) is not None:
                heapq.heappush(heap, (r, k))
        return left

    def plain(self, word: str) -> int:
        """Tokens of text without special strings."""
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
        total = 0
        for p in self.split(word.lower()):
            n = self.pieces.get(p)
            if n is None:
                if len(self.pieces) >= CACHE:
                    self.pieces.clear()
                n = self.pieces[p] = self.merged(p)
            total += n
        return total

    def word(self, word: str) -> int:
        if self.found and "<" in word:
            return sum(1 if x in self.special else self.plain(x) for x in self.found.split(word) if x)
        return self.plain(word)

    def count(self, text: str) -> int:
        """Tokens of one whole text. Words between blanks are independent: the pre-tokeniser drops white space."""
        words, known = _WORDS(text), self.words
        for w in set(words).difference(known):
            known[w] = self.older[w] if w in self.older else self.word(w)
        total = sum(map(known.__getitem__, words))
        if len(known) > CACHE:
            self.words, self.older = {}, known
        return total


_counters: dict[str, PairCounter] = {}


def counter_of(path: str) -> PairCounter:
    """One counter in a Python worker, whatever tasks it runs."""
    if path not in _counters:
        _counters[path] = PairCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text has 0 bytes and 0 tokens. Equal rows each get a row, an
    empty table none; other columns of ``docs`` are not read. No text is cut.
    """
    prepare(docs.sparkSession)

    def make():
        counter = counter_of(path)

        def f(keys, texts):
            return [keys, [len((t or "").encode("utf-8", "surrogatepass")) for t in texts], [counter.count(t or "") for t in texts]]

        return f

    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs, make, key, text, f"`{key}` {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
