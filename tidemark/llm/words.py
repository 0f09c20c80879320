"""Word hashes of whole texts as vector operations.

Words are runs of bytes other than ASCII white space, with A-Z in lower case.
A word's hash comes from prefix sums of byte values times powers of an odd
number modulo 2**64, so every word of a text is hashed in a few numpy calls.
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ROLL = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate(([np.uint64(1)], np.cumprod(np.full(2 * n, base, np.uint64))))
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words begin and end."""
    blank = np.concatenate(([True], _BLANK[np.frombuffer(raw, np.uint8)], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word of UTF-8 text."""
    begin, end = word_spans(raw)
    if not len(begin):
        return np.zeros(0, np.uint64), begin, end
    power, inverse = _power(len(raw))
    low = np.frombuffer(raw.lower(), np.uint8)  # bytes.lower() changes A-Z alone
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_VALUE[low] * power[: len(low)], dtype=np.uint64)))
    return mix((sums[end] - sums[begin]) * inverse[begin]), begin, end


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total += words[k : k + m] * _ROLL[k]
    return mix(total)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of n words; a shorter text has its whole sequence as one, no words none."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass"))[0]
    if not len(words):
        return words
    if len(words) < n:
        return mix(grams(words, len(words)) + np.uint64(len(words)))
    return np.unique(grams(words, n))


def word_pipeline(spec: dict) -> str | None:
    """The pre-tokeniser's pattern of a ``tokenizers`` file whose white space and letter case go before it merges; None for other files.

    The normaliser has to be NFC, white space as one blank, lower case; the
    pre-tokeniser the matches of a pattern, then bytes; the model BPE with a word
    end and nothing that makes a result depend on anything else.
    """
    norm = (spec.get("normalizer") or {}).get("normalizers") or []
    kinds = [n.get("type") for n in norm]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or []
    model = spec["model"]
    ok = kinds == ["NFC", "Replace", "Lowercase"] and norm[1].get("pattern") == {"Regex": r"\s+"} and norm[1].get("content") == " "
    ok = ok and [p.get("type") for p in pre] == ["Split", "ByteLevel"] and pre[0].get("behavior") == "Removed" and bool(pre[0].get("invert")) and "Regex" in pre[0]["pattern"]
    ok = ok and not pre[1].get("add_prefix_space") and not pre[1].get("use_regex", True)
    ok = ok and model.get("type") == "BPE" and bool(model.get("end_of_word_suffix"))
    ok = ok and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
    ok = ok and not any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    pattern = pre[0]["pattern"]["Regex"] if ok else None
    # a class of what is no blank, letter or number is the one place where blanks may stand
    return pattern if ok and pattern.replace(r"[^\s", "[^").count(r"\s") == 0 else None
