"""SentencePiece encoding and decoding as shortest paths through a weighted finite-state transducer.

Three machines are compiled from a ``.model`` file into tables:

* the normaliser first rewrites by the file's own character map, the longest rule at each
  place (``Rewriter``, a trie read out of the file's double array), then reads runs of
  blanks and of other characters: (state, kind of run) gives the next state and what it
  writes (the dummy prefix, blanks as U+2581);
* the pieces are a trie: (state, character) gives the next state, and states where a
  piece ends have its id and weight;
* byte fallback has an arc for each character that is no piece: its UTF-8 bytes' ids,
  or the unknown id where the model has no bytes.

The first one's output is the input of the other two, which are composed with it
place by place (``arcs``), and encoding is the path of least weight in the tropical
semiring (min, +) over states (place, context) (``shortest``), for both kinds of model:

* unigram models: an arc weighs minus the piece's score; there is no context;
* BPE models: the context is the last piece, and an arc weighs 0 where merging
  the two pieces' characters by rank would leave exactly these two pieces, and
  infinity otherwise. A sequence all of whose neighbours pass is the sequence
  that merging gives, and it is the only one, so the path of weight 0 is it.
  Weights of 0 and infinity need no minimum: the longest arcs are followed
  first and places that lead nowhere are left out (``first``).

No piece goes on past a blank, so texts are cut before blanks and paths of words
that come again are kept in two generations of ``CACHE`` entries a worker.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import prepare

CACHE = 200_000
BLANK = "▁"
INF = float("inf")
#: States of the normaliser: nothing written yet, in text, behind blanks that may be the last.
BEGIN, TEXT, BEHIND = range(3)
_RUNS = re.compile(r" +|[^ ]+").findall


def wire(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protobuf message."""
    at, end = 0, len(raw)

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < end:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, raw[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", raw[at : at + size])[0]
            at += size


def character_map(raw: bytes) -> dict[str, str]:
    """Rules of a compiled character map: a double array over UTF-8 bytes whose leaves are places in a block of texts ending in a null byte.

    A unit holds its byte, bit 8 (a leaf hangs on it) and the offset of its children, which lie at the offset XOR their
    byte. All nodes of a depth are expanded at once.
    """
    size = struct.unpack_from("<I", raw)[0]
    units, texts = np.frombuffer(raw, "<u4", size // 4, 4).astype(np.int64), raw[4 + size :]
    if not len(units):
        return {}

    def children(at):
        return at ^ ((units[at] >> 10) << ((units[at] & 512) >> 6))

    labels, rules = np.arange(1, 256), {}
    nodes, keys = children(np.zeros(1, np.int64)), [b""]
    while len(keys):
        places = nodes[:, None] ^ labels
        inside = places < len(units)
        own, byte = np.nonzero(inside & ((units[np.where(inside, places, 0)] & 0x800000FF) == labels))
        at = places[own, byte]
        keys = [keys[i] + bytes((b,)) for i, b in zip(own.tolist(), labels[byte].tolist(), strict=True)]
        nodes = children(at)
        for i in np.flatnonzero(units[at] >> 8 & 1).tolist():
            begin = int(units[nodes[i]] & 0x7FFFFFFF)
            rules[keys[i].decode()] = texts[begin : texts.index(b"\0", begin)].decode()
    return rules


class Rewriter:
    """Replaces the longest key of ``rules`` at each place, from left to right."""

    def __init__(self, rules: dict[str, str]):
        self.go: list[dict[str, int]] = [{}]
        self.out: list[str | None] = [None]
        for key, text in rules.items():
            at = 0
            for c in key:
                at = self.go[at].setdefault(c, len(self.go))
                if at == len(self.go):
                    self.go.append({})
                    self.out.append(None)
            self.out[at] = text
        # a rule begins only at a character that is a key, or before one that is second in a key
        alone, second = ("".join(sorted(x)) for x in ({k for k in rules if len(k) == 1}, {k[1] for k in rules if len(k) > 1}))
        ways = [x for x, some in ((f"[{re.escape(alone)}]", alone), (f".(?=[{re.escape(second)}])", second)) if some]
        self.next = re.compile("|".join(ways) or "(?!)", re.DOTALL).search

    def __call__(self, text: str) -> str:
        if not (m := self.next(text)):
            return text
        go, rule, out, done, n = self.go, self.out, [], 0, len(text)
        while m:
            begin = m.start()
            out.append(text[done:begin])
            at, done, new = 0, begin + 1, text[begin]
            for end in range(begin, n):
                at = go[at].get(text[end], -1)
                if at < 0:
                    break
                if rule[at] is not None:
                    done, new = end + 1, rule[at]
            out.append(new)
            m = self.next(text, done)
        out.append(text[done:])
        return "".join(out)


class PieceTransducer:
    """The compiled machines of one model, with ``encode`` and ``decode``."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(wire(f.read()))
        self.pieces: list[tuple[str, float, int]] = []
        trainer, norm = {}, {}
        for n, value in fields:
            if n == 1:
                p = dict(wire(value))
                self.pieces.append((p.get(1, b"").decode(), p.get(2, 0.0), p.get(3, 1)))
            elif n == 2:
                trainer = dict(wire(value))
            elif n == 3:
                norm = dict(wire(value))
        if not norm.get(5, 1) or trainer.get(24):
            raise ValueError("only models that mark blanks, and mark them before words, are supported")
        self.unigram = trainer.get(3, 1) == 1
        if not self.unigram and trainer.get(3) != 2:
            raise ValueError("only unigram and BPE models are supported")
        if any(kind in (4, 5) for _, _, kind in self.pieces):
            raise ValueError("models with user-defined or unused pieces are not supported")
        rules = character_map(norm[2]) if norm.get(2) else {}
        self.rewrite = Rewriter(rules) if rules else None
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == 1}
        self.score = [s for _, s, _ in self.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == 6}
        self.unknown = next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == 2), 0)
        self.floor = min((s for _, s, kind in self.pieces if kind == 1), default=0.0) - 10
        self.out = [bytes([int(p[3:5], 16)]) if kind == 6 else b"" if kind == 3 else b" \xe2\x81\x87 " if kind == 2 else p.replace(BLANK, " ").encode() for p, _, kind in self.pieces]
        inner = any(BLANK in p.lstrip(BLANK) for p in self.ids)
        newline = any("\n" in p for p in self.ids)
        blank_end = "" if newline else r"\n"
        self.cut = re.compile(rf"{BLANK}+[^{BLANK}{blank_end}]*|[^{BLANK}{blank_end}]+|\n+").findall if not inner else lambda t: [t]
        counts: dict[float, int] = {}
        for s in self.score:
            counts[s] = counts.get(s, 0) + 1
        self.tied = {i for i in self.ids.values() if counts[self.score[i]] > 1 and len(self.pieces[i][0]) > 1}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.compile()

    # --- machines

    def compile(self) -> None:
        """Tables of the normaliser, the trie of pieces and byte fallback."""
        # (state, blanks?) -> next state, what goes before the run, whether the run is written
        first = BLANK if self.prefix else ""
        if self.squeeze:
            self.steps = {(BEGIN, True): (BEGIN, "", False), (BEGIN, False): (TEXT, first, True), (TEXT, True): (BEHIND, "", False), (BEHIND, False): (TEXT, BLANK, True)}
        else:
            self.steps = {(BEGIN, True): (TEXT, first, True), (BEGIN, False): (TEXT, first, True), (TEXT, True): (TEXT, "", True), (TEXT, False): (TEXT, "", True)}
        self.go: list[dict[str, int]] = [{}]
        self.piece_at: list[int] = [-1]
        for p, k in self.ids.items():
            at = 0
            for c in p:
                at = self.go[at].setdefault(c, len(self.go))
                if at == len(self.go):
                    self.go.append({})
                    self.piece_at.append(-1)
            # a BPE piece that merging never makes has no arc
            self.piece_at[at] = k if self.unigram or len(p) == 1 or self.split(k) else -1
        self.cost = [-s if self.unigram else 0.0 for s in self.score]
        self.fallback = -self.floor if self.unigram else 0.0
        # BPE: a piece's length, the longest shorter piece it begins with that has an arc, its halves, and the rank of two pieces that merge
        n = self.n = len(self.pieces)
        self.size, self.shorter, self.left, self.right = [len(p) for p, _, _ in self.pieces], [-1] * n, [-1] * n, [-1] * n
        self.joined: dict[int, float] = {}
        self.whole = not self.unigram and all(c in self.ids for c in set("".join(self.ids)))
        if not self.whole:
            return
        for p, k in self.ids.items():
            if halves := self.split(k):
                self.left[k], self.right[k] = halves
            at = 0
            for c in p[:-1]:
                at = self.go[at][c]
                if self.piece_at[at] >= 0:
                    self.shorter[k] = self.piece_at[at]
            for i in range(1, len(p)):
                a, b = self.ids.get(p[:i]), self.ids.get(p[i:])
                if a is not None and b is not None:
                    self.joined[a * n + b] = self.score[k]

    def normal(self, text: str) -> str:
        if self.rewrite and not (text := self.rewrite(text)):
            return "" if self.squeeze or not self.prefix else BLANK
        if text and "  " not in text and text[0] != " " and text[-1] != " ":
            # blanks one at a time between other runs: the machine goes around TEXT and BEHIND alone
            text = (self.steps[BEGIN, False][1] + text).replace(" ", BLANK)
            return text.rstrip(BLANK) if self.squeeze else text
        state, out = BEGIN, []
        for run in _RUNS(text):
            state, before, kept = self.steps[state, run[0] == " "]
            out.append(before)
            if kept:
                out.append(run)
        text = "".join(out).replace(" ", BLANK)
        # blanks that stand as U+2581 in the text go at its end alone
        return text.rstrip(BLANK) if self.squeeze else text

    # --- weights between neighbours (BPE)

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Symbols after merging by score, leftmost first, and the last pair merged: what a weight is defined by."""
        sym, last = list(text), None
        while True:
            best, at = -INF, -1
            for i in range(len(sym) - 1):
                k = self.ids.get(sym[i] + sym[i + 1])
                if k is not None and self.score[k] > best:
                    best, at = self.score[k], i
            if at < 0:
                return sym, last
            last = (sym[at], sym[at + 1])
            sym[at : at + 2] = [sym[at] + sym[at + 1]]

    def split(self, piece: int) -> tuple[int, int] | None:
        """The two pieces that ``piece`` is merged from; None for one character or a piece that merging never makes."""
        if piece not in self.halves:
            sym, last = self.merge(self.pieces[piece][0])
            self.halves[piece] = (self.ids[last[0]], self.ids[last[1]]) if len(sym) == 1 and last and last[0] in self.ids and last[1] in self.ids else None
        return self.halves[piece]

    def weight(self, a: int, b: int) -> float:
        """0 if pieces a and b can stand side by side, else infinity. Negative ids are characters with byte fallback."""
        if a < 0 or b < 0:
            return 0.0
        ok = self.pairs.get(a * self.n + b)
        return 0.0 if (self.beside(a, b) if ok is None else ok) else INF

    def beside(self, a: int, b: int) -> bool:
        """Work out whether two pieces can stand side by side, and keep it."""
        if len(self.pairs) > CACHE:
            self.pairs.clear()
        if a in self.tied or b in self.tied or not self.whole:
            ok = self.merge(self.pieces[a][0] + self.pieces[b][0])[0] == [self.pieces[a][0], self.pieces[b][0]]
        else:
            ok = self.apart(a, b)
        self.pairs[a * self.n + b] = ok
        return ok

    def apart(self, a: int, b: int) -> bool:
        """Undo merges from the last to the first; a pair across the border that outranks what was undone would have been merged."""
        n, joined, score, lefts, rights = self.n, self.joined, self.score, self.left, self.right
        bound, left = -INF, False  # a merge across must not outrank the bound; equal ranks go to the leftmost pair
        while True:
            rank = joined.get(a * n + b)
            if rank is not None and (rank > bound or rank == bound and left):
                return False
            before, behind = rights[a], lefts[b]
            if before < 0 and behind < 0:
                return True
            if behind >= 0 and (before < 0 or score[b] <= score[a]):  # of equal ranks the left piece was merged first, so undo the right one
                bound, left, b = score[b], True, behind
            else:
                bound, left, a = score[a], False, before

    # --- composition and shortest path

    def arcs(self, word: str, begin: int) -> list[tuple[int, int, float]]:
        """The composed machine's arcs from a place: (end, id, weight). A negative id is a character's byte fallback."""
        go, piece_at, cost, out, at = self.go, self.piece_at, self.cost, [], 0
        for end in range(begin, len(word)):
            at = go[at].get(word[end], -1)
            if at < 0:
                break
            if (k := piece_at[at]) >= 0:
                out.append((end + 1, k, cost[k]))
        if not out or out[0][0] > begin + 1:
            out.append((begin + 1, -2 - ord(word[begin]), self.fallback))
        return out

    def shortest(self, word: str) -> list[int]:
        """Ids on the path of least weight through one normalised word.

        States are (place, context). A place has one context of finite weight: unigram models have none to tell
        apart, and merging a beginning of the word has one result, which is all that BPE weights let through.
        """
        if self.whole:
            return self.first(word)
        n, unigram, arcs = len(word), self.unigram, self.arcs
        weight, context, back = [INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        weight[0] = 0.0
        for begin in range(n):
            if (w := weight[begin]) == INF:
                continue
            a = context[begin]
            for end, k, x in arcs(word, begin):
                x += w
                if x >= weight[end]:
                    continue
                if not unigram and begin and self.weight(a, k):
                    continue
                weight[end], context[end], back[end] = x, k, begin
        out, at = [], n
        while at:
            out.append(context[at])
            at = back[at]
        return out[::-1]

    def first(self, word: str) -> list[int]:
        """``shortest`` where arcs weigh 0 or infinity: depth first, from each place by its longest arc that may follow.

        A place has one context of finite weight, so one that was left again leads nowhere whatever comes before it.
        """
        n, m, go, piece_at, size, shorter, pairs = len(word), self.n, self.go, self.piece_at, self.size, self.shorter, self.pairs
        out: list[int] = []
        dead: set[int] = set()
        begin, a = 0, -2
        while begin < n:
            k, at = -1, 0
            for end in range(begin, n):
                at = go[at].get(word[end], -1)
                if at < 0:
                    break
                if piece_at[at] >= 0:
                    k = piece_at[at]
            if k < 0:
                a = -2 - ord(word[begin])
                out.append(a)
                begin += 1
                continue
            while True:
                if k < 0:  # no arc is left here
                    dead.add(begin)
                    k = out.pop()
                    begin -= size[k] if k >= 0 else 1
                    a = out[-1] if out else -2
                    k = shorter[k] if k >= 0 else -1
                    continue
                if dead and begin + size[k] in dead:
                    k = shorter[k]
                    continue
                if a < 0:
                    break
                ok = pairs.get(a * m + k)
                if ok or ok is None and self.beside(a, k):
                    break
                k = shorter[k]
            out.append(k)
            begin += size[k]
            a = k
        return out

    def word_ids(self, word: str) -> bytes:
        path, got = self.shortest(word), []
        if path and min(path) >= 0:
            return struct.pack(f"<{len(path)}i", *path)
        for k in path:
            if k >= 0:
                got.append(k)
            elif self.bytes:
                got += [self.bytes[b] for b in chr(-2 - k).encode("utf-8", "surrogatepass")]
            elif not got or got[-1] != self.unknown:
                got.append(self.unknown)
        return struct.pack(f"<{len(got)}i", *got)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        words, known = self.cut(self.normal(text)), self.words
        for w in set(words).difference(known):
            known[w] = self.older.get(w) or self.word_ids(w)
        out = b"".join(map(known.__getitem__, words))
        if len(known) > CACHE:
            self.words, self.older = {}, known
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of an id sequence; bytes that are no UTF-8 become U+FFFD, and the dummy prefix goes.

        Of a model that squeezes blanks each piece before the first character gives one up.
        """
        parts = [self.out[i] for i in ids]
        for n, i in enumerate(ids if self.prefix or self.squeeze else ()):
            if blank := parts[n][:1] == b" " and self.pieces[i][2] == 1:
                parts[n] = parts[n][1:]
            if parts[n] or blank and not self.squeeze:
                break
        return b"".join(parts).decode("utf-8", "replace")


_machines: dict[str, PieceTransducer] = {}


def machine_of(path: str) -> PieceTransducer:
    """One compiled transducer in a Python worker, whatever tasks it runs."""
    if path not in _machines:
        _machines[path] = PieceTransducer(path)
    return _machines[path]


def encode_pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, ids (array of int), n_pieces, ids_crc32, round_trip.

    ``round_trip`` is true where decoding gives the text back, with U+2581 as
    blank. A null or empty text has no ids. Repeated rows each get a row; other
    columns are not read.
    """
    prepare(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    from pyspark.sql import functions as F

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for b in batches:
            raws, same = [], []
            for t in b.column(1).to_pylist():
                raws.append(raw := machine.encode(t or ""))
                same.append(machine.decode(np.frombuffer(raw, "<i4").tolist()) == (t or "").replace(BLANK, " "))
            sizes = np.array([len(r) // 4 for r in raws], np.int64)
            offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(raws), "<i4"), pa.int32())
            cols = [b.column(0), pa.ListArray.from_arrays(offsets, values), pa.array(sizes), pa.array([zlib.crc32(r) for r in raws], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[key, "ids", "n_pieces", "ids_crc32", "round_trip"])

    return docs.select(key, F.col(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, ids array<int>, n_pieces long, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Texts of id arrays: key, text. Null ids give an empty text."""
    prepare(encoded.sparkSession)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = machine_of(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([machine.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
