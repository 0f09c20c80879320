"""Source divergence, Merkle manifest and line dedup against plain Python, on awkward rows too."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, docs string, term string, path string, hits string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, columns with the operators' own names."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "ÀÉ", "straße", "中文", "x1y", "Alpha", "beta2"]
    rows = []
    for i in range(60):
        lines = [rnd.choice([" ", "\t", ""]) + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 3))) + rnd.choice([" \r", "", "\x0b"]) for _ in range(rnd.randint(0, 6))]
        rows.append((i, "\n".join(lines), rnd.choice(["en", "de", None, "", "one"]), rnd.choice(["a", "b", None, "é"]), i))
    rows += [(1, None, "en", "a", None), (None, "Alpha\n\nalpha", "en", "b", 3), (None, "", None, None, None), (7, "\n\n", "de", "a", 1), (7, "\n\n", "de", "a", 1)]
    rows += [(100, "Alpha beta " * 30_000 + "\nalpha", "en", "c", 1), (101, "lonely", "xx", "a", 1), (102, " \n ALPHA \n", "xx", "b", -5), (103, "\x1cAlpha\xa0", "en", "a", 2)]
    return spark.createDataFrame([(*r, 1, "k", "d", "t", "p", "h") for r in rows], SCHEMA)


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def divergence(rows, least, top):
    """(lang, source, text) rows to the result, term by term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    docs, counts = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, source in counts:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, mine = len(kept), [s for g, s in counts if g == lang]

        def p(count, of):
            return 1 + 10**9 * (count[t] + 2) // (sum(count[x] for x in of) + 2 * len(of))

        whole = sum((counts[lang, s] for s in mine), collections.Counter())
        values = collections.defaultdict(int)
        best = []
        for t in kept:
            own = p(counts[lang, source], kept)
            for s in mine:
                q = p(counts[lang, s], kept)
                values[s] += (own - q) ** 2 // (own + q)
            q = p(whole, kept)
            if counts[lang, source][t] and own > q:
                best.append((-((own - q) ** 2 // (own + q)), t.encode(), t))
        pairs = sorted((-values[s] if v else 0, s.encode(), s) for s in mine if s != source)
        out += [(lang, source, "pair", s, -x, k) for k, (x, _, s) in enumerate(pairs, 1)]
        out += [(lang, source, "term", s, -x, k) for k, (x, _, s) in enumerate(sorted(best)[:top], 1)]
    return collections.Counter(out)


@pytest.mark.parametrize("least,top", [(1, 2), (3, 10), (10, 10), (1000, 10)])
def test_divergence_of_awkward_rows(spark, odd, least, top, monkeypatch):
    from tidemark.llm import source_divergence as m

    monkeypatch.setattr(m, "SHARD_ROWS", 7)  # several shards a language
    monkeypatch.setattr(m, "DENSE", 6)
    got = collections.Counter(map(tuple, m.source_divergence(odd, least, top).collect()))
    assert got == divergence(rows_of(odd, "lang", "source", "text"), least, top) and got
    assert m.source_divergence(odd.limit(0)).count() == 0


def test_scale_in_two_factors_is_exact():
    from tidemark.llm.source_divergence import scaled

    rnd = random.Random(2)
    for _ in range(2000):
        total = rnd.randint(5, 10 ** rnd.randint(1, 14))
        count = rnd.randint(0, total - 2)
        assert scaled(np.array([count]), np.array([total])).tolist() == [1 + 10**9 * (count + 2) // total]


def test_tasks_pass_counts_on_when_they_hold_many(monkeypatch):
    import pyarrow as pa

    from tidemark.llm import source_divergence as m

    monkeypatch.setattr(m, "HELD_ROWS", 4)
    batches = [pa.RecordBatch.from_pydict({"lang": ["en"] * 3, "source": ["a", "b", "a"], "text": [f"w{chr(97 + i)} x", "", "X x y"]}) for i in range(6)]
    total = collections.Counter()
    for b in m.partial_counts(iter(batches)):
        for r in b.to_pylist():
            total.update({(r["source"], r["term"], "n"): r["n"], (r["source"], r["term"], "docs"): r["docs"]})
    assert (total["a", "x", "n"], total["a", "x", "docs"], total["a", "y", "docs"], total["a", "wa", "n"]) == (18, 12, 6, 1)


def tree(leaves):
    """All levels from the leaves to the root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([hashlib.sha256("".join(out[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(out[-1]), 8)])
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_postorder_places(levels):
    from tidemark.llm.merkle_manifest import append_log, place

    for n in (1, 2, 7, 8, 9, 63, 64, 65, 200, 512):
        if n > 8**levels:
            continue
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        log = append_log(leaves, levels)
        nodes, at = [leaves], []
        for _ in range(levels):
            nodes.append([hashlib.sha256("".join(nodes[-1][i : i + 8]).encode()).hexdigest() for i in range(0, len(nodes[-1]), 8)])
        for k, row in enumerate(nodes):
            where = place(k, np.arange(len(row)), n, levels).tolist()
            assert [log[i] for i in where] == row
            at += where
        assert sorted(at) == list(range(len(log)))


def text_of(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def proofs(rows, changed):
    """(doc_id, source, lang, n_chars, text) rows to the result's rows."""
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    by = collections.defaultdict(list)
    for r in rows:
        other = (*r[:4], None if r[4] is None else changed(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r
        by[r[2]].append(((r[0] is not None, r[0] or 0, sha(text_of(*r))), r[0], sha(text_of(*r)), sha(text_of(*other))))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([r[2] for r in sorted(by[x])]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for at, x in enumerate(langs):
        for i, (_, key, leaf, said) in enumerate(sorted(by[x])):
            h, siblings = said, ""
            for nodes, j in ((trees[x], i), (top, at)):
                for row in nodes[:-1]:
                    run = row[j - j % 8 : j - j % 8 + 8]
                    siblings += "".join(run[: j % 8] + run[j % 8 + 1 :])
                    h = sha("".join([*run[: j % 8], h, *run[j % 8 + 1 :]]))
                    j //= 8
            out.append((key, leaf, trees[x][-1][0], top[-1][0], sha(siblings), h, h == top[-1][0]))
    return collections.Counter(out)


@pytest.mark.parametrize("levels", [1, 2, 4])
def test_merkle_proofs_of_awkward_rows(spark, odd, levels):
    """One level a builder makes several layers in every tree and in the tree over the languages."""
    import string

    from pyspark.sql import functions as F

    from tidemark.llm.merkle_manifest import build_manifest, extract_proofs, fold, leaf_digest

    more = spark.createDataFrame([(i, f"Text {i % 50}", f"l{i % 11}" if i % 3 else "en", "s", i) for i in range(700)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = odd.select(*more.columns).union(more)
    changed = lambda t: t.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    digest = lambda text: leaf_digest("doc_id", "source", "lang", "n_chars", text)
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("key"), digest("text").alias("digest"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, digest(F.translate("text", string.ascii_uppercase, string.ascii_lowercase))).alias("claimed"))
    manifest = build_manifest(leaves, levels)
    got = extract_proofs(manifest, siblings=True).collect()
    cols = ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert collections.Counter(tuple(r[c] for c in cols) for r in got) == proofs(rows_of(docs, "doc_id", "source", "lang", "n_chars", "text"), changed)
    assert {r.verified for r in got} == {True, False} and [r.root for r in manifest.root().collect()] == [got[0].root]
    assert all(fold(r.leaf, [tuple(x) for x in r.proof]) == r.root for r in got)
    manifest.drop()


def test_merkle_of_few_rows(spark):
    from tidemark.llm.merkle_manifest import build_manifest, extract_proofs

    schema = "tree string, key long, digest string, claimed string"
    none = build_manifest(spark.createDataFrame([], schema))
    assert extract_proofs(none).count() == 0 and none.root().count() == 0
    leaf = hashlib.sha256(b"x").hexdigest()
    (one,) = extract_proofs(build_manifest(spark.createDataFrame([(None, None, leaf, None)], schema))).collect()
    assert one.leaf == one.subroot == one.root == leaf and one.verified and one.proof_sha256 == hashlib.sha256(b"").hexdigest()


def line_key(line):
    return line.encode().strip(b" \t\n\x0b\x0c\r").lower()


def without_lines(texts, least):
    docs = collections.Counter(itertools.chain.from_iterable({line_key(x) for x in (t or "").split("\n")} for t in texts))
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (line_key(x) and docs[line_key(x)] >= least)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_lines_of_awkward_rows(spark, odd, most):
    """By filters sent to tasks, and by the join with the exact table that takes their place beyond the bound."""
    from tidemark.llm.line_dedup import LineIndex, drop_lines

    rows = rows_of(odd, "doc_id", "text")
    for least in (1, 2, 10):
        got = drop_lines(odd, LineIndex.create(spark, least).insert(odd), most=most)
        want = collections.Counter((k, *x) for (k, _), x in zip(rows, without_lines([t for _, t in rows], least), strict=True))
        assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and collections.Counter(map(tuple, got.collect())) == want
    none = odd.limit(0)
    assert drop_lines(none, LineIndex.create(spark).insert(none), most=most).count() == 0


def test_line_index_is_reversible(spark, monkeypatch):
    from tidemark.llm import line_dedup as m

    monkeypatch.setattr(m, "SHARD_KEYS", 40)  # shards are made anew on the way
    rnd = random.Random(4)
    batches = [spark.createDataFrame([(i, "\n".join(f"line {int(rnd.paretovariate(0.6))}" for _ in range(8))) for i in range(120)], "doc_id long, text string") for _ in range(3)]

    def state(index):
        refs = {bytes(r.key): r.n for r in index.refs.collect()}
        opened = index.opened()
        return refs, {k for k in refs if opened.contains([k])[0]}

    first = m.LineIndex.create(spark, 5).insert(batches[0])
    second = first.insert(batches[1])
    third = second.insert(batches[2])
    at = [state(x) for x in (first, second, third)]
    assert all(hits == {k for k, n in refs.items() if n >= 5} for refs, hits in at) and len({len(h) for _, h in at}) == 3 and third.shards > 1
    assert state(third.delete(batches[2])) == at[1] and state(third.delete(batches[2]).delete(batches[1])) == at[0]
    assert state(third.delete(batches[1]).insert(batches[1])) == at[2]
    gone = first.delete(batches[0])
    assert state(gone) == ({}, set())
    with pytest.raises(ValueError, match="never inserted"):
        gone.delete(batches[0])


def test_cuckoo_filter():
    from tidemark.llm.line_dedup import CuckooFilter, LineFilters, as_keys

    keys = as_keys([hashlib.md5(str(i).encode()).digest() for i in range(20_000)])
    f = CuckooFilter.empty(10_000)
    assert f.insert(keys[:10_000]) and f.contains(keys[:10_000]).all() and not f.contains(keys[10_000:]).any()
    f = CuckooFilter.load(f.dump())
    f.delete(keys[:5_000])
    assert not f.contains(keys[:5_000]).any() and f.contains(keys[5_000:10_000]).all()
    with pytest.raises(ValueError):
        f.delete(keys[:1])
    assert not CuckooFilter.empty(10).insert(keys[:1000])  # full
    taken = keys[5_000].tobytes()
    filters = LineFilters({0: f.dump()}, 1, frozenset([taken]))
    assert filters.contains([taken, keys[5_001].tobytes(), keys[0].tobytes()]) == [False, True, False]
