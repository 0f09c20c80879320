"""Text operators against libraries, brute force, exact round trips and awkward rows."""

from __future__ import annotations

import collections
import hashlib
import random
import struct
import re
import zlib

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
HARD = [None, "", " ", "\n\t", "a", "one two", "Straße ÀÉ 1.5km İ. ΣΑΣ", "é́ x", "</s>[INST] \\ok [/INST]", "<|endoftext|> b <|startoftext|>", "▁ ▁▁ x", "中文 テスト 😀", "x\x1cy z\xa0w", "word " * 3000, "<s> <0x0A> <unk>"]


def vocab(name):
    import public_tokenizers

    return public_tokenizers.path(name)


def texts(n=150):
    import duckdb

    rnd = random.Random(3)
    alphabet = "abcdefghij éßñ ABZ .,!?'\n\t12<>|[]\\▁😀中"
    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(500)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null key and clashing extra columns."""
    rows = [(i, t, "en", i) for i, t in enumerate(HARD)] + [(4, "a", "en", 0), (None, "two words here", None, 1), (99, HARD[6], "de", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n long")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, n long")


def test_sentence_pieces_are_the_library_s():
    import sentencepiece

    from tidemark.llm.sentence_pieces import PieceTransducer

    lib, own = sentencepiece.SentencePieceProcessor(model_file=vocab("piece_bpe_32k.model")), PieceTransducer(vocab("piece_bpe_32k.model"))
    for t in texts() + [x for x in HARD if x]:
        ids = np.frombuffer(own.encode(t), "<i4").tolist()
        assert ids == lib.encode(t)
        assert own.decode(ids) == lib.decode(ids)


def test_unigram_path_is_the_best_of_all_paths():
    from tidemark.llm.sentence_pieces import PieceTransducer

    m = PieceTransducer.__new__(PieceTransducer)
    rnd = random.Random(1)
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca"]
    m.pieces = [(p, -rnd.random() * 5, 1) for p in pieces]
    m.ids, m.score = {p: i for i, p in enumerate(pieces)}, [s for _, s, _ in m.pieces]
    m.unigram, m.floor, m.pairs, m.prefix, m.squeeze, m.rewrite = True, -20.0, {}, True, True, None
    m.compile()
    assert m.normal("  a  b ") == "▁a▁b" and m.normal("   ") == ""

    def best(word):
        if not word:
            return 0.0
        return min(-m.score[m.ids[word[:i]]] + best(word[i:]) for i in range(1, len(word) + 1) if word[:i] in m.ids)

    for _ in range(50):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 8)))
        assert sum(-m.score[k] for k in m.shortest(w)) == pytest.approx(best(w))


def with_map(rule, kind, prefix, squeeze, symbols=()):
    """The 32k model's file with another kind, the character map of ``rule`` and user-defined pieces.

    Unigram scores are multiples of 2**-11, which the library adds without rounding.
    """
    import sentencepiece

    from tidemark.llm.sentence_pieces import wire

    def varint(n):
        return bytes((n,)) if n < 128 else bytes((n & 127 | 128,)) + varint(n >> 7)

    def put(n, value):
        if isinstance(value, float):
            return varint(n << 3 | 5) + struct.pack("<f", value)
        return varint(n << 3 | 2) + varint(len(value)) + value if isinstance(value, bytes) else varint(n << 3) + varint(value)

    def piece(i, raw):
        p = dict(wire(raw))
        return put(1, p[1]) + put(2, -4 - i / 2048) + put(3, p.get(3, 1)) if kind == 1 else raw

    with open(vocab("piece_bpe_32k.model"), "rb") as f:
        fields = list(wire(f.read()))
    (chars,) = [dict(wire(v))[2] for n, v in wire(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()) if n == 3]
    norm = put(1, rule.encode()) + put(2, chars) + put(3, prefix) + put(4, squeeze) + put(5, 1)
    pieces = b"".join(put(1, piece(i, v)) for i, (n, v) in enumerate(fields) if n == 1) + b"".join(put(1, put(1, x.encode()) + put(3, 4)) for x in symbols)
    return pieces + put(2, put(3, kind) + put(35, 1)) + put(3, norm)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_models_with_a_character_map_are_the_library_s(rule, tmp_path):
    import sentencepiece

    from tidemark.llm.sentence_pieces import PieceTransducer, Rewriter, character_map

    odd_ones = ["ﬁne ﬀ ① Ⅷ ½", "ｆｕｌｌ　ｗｉｄｔｈ", "e\u0301 A\u030a\u0301 \u0301", "\u1112\u1161\u11ab한", "a\u00a0b\u200bc\u2028d\te\nf\r\n", "\x01\x02", "\x01", "\u3000 x \u3000", "ＡÅ ẛ̣ ſ ß STRASSE İ", "㍿ ㌔ ﷺ", "▁ x ▁▁", "<sep>Ａ<sep><sep> b<se"]
    rnd = random.Random(3)
    pool = [c for x in odd_ones for c in x] + list("ab  .")
    mixed = ["".join(rnd.choice(pool) for _ in range(rnd.randint(1, 40))) for _ in range(400)]
    for kind, prefix, squeeze in ((1, 1, 1), (2, 1, 1), (1, 0, 1), (1, 1, 0), (2, 0, 0)):
        path = tmp_path / f"{kind}{prefix}{squeeze}.model"
        path.write_bytes(with_map(rule, kind, prefix, squeeze))
        lib, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), PieceTransducer(str(path))
        for t in odd_ones + mixed + texts(30) + [x for x in HARD if x]:
            ids = np.frombuffer(own.encode(t), "<i4").tolist()
            assert ids == lib.encode(t), (kind, prefix, squeeze, t)
            assert own.decode(ids) == lib.decode(ids), (kind, prefix, squeeze, t)
    assert character_map(b"\0\0\0\0") == {}
    rewrite = Rewriter({"ab": "x", "abc": "y", "b": "", "c": "cc"})
    assert [rewrite(t) for t in ("abcab", "aab", "cabc", "zz", "", "bbb")] == ["yx", "ax", "ccy", "zz", "", ""] and Rewriter({})("ab") == "ab"
    for kind in (1, 2):
        path.write_bytes(with_map(rule, kind, 1, 1, ("<sep>",)))
        with pytest.raises(ValueError):
            PieceTransducer(str(path))


def test_token_counts_and_words_are_the_library_s():
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import PairCounter
    from tidemark.llm.token_files import WordEncoder

    path = vocab("word_bpe_49k.json")
    all_ = texts() + [t or "" for t in HARD]
    counter, encoder = PairCounter(path), WordEncoder(path)
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(all_, add_special_tokens=False)]
    assert [counter.count(t) for t in all_] == [len(x) for x in want]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(all_)] == want


def test_elias_fano_selects_every_boundary():
    from tidemark.llm.token_files import Block, EliasFano, pack_block

    for values in ([], [0], [5], [0, 0, 0, 7], np.cumsum(np.random.default_rng(1).integers(0, 500, 700)).tolist()):
        ef = EliasFano.load(EliasFano.build(np.array(values, np.int64)).dump())
        assert ef.all().tolist() == values == [ef.select(i) for i in range(len(values))]
    wide = [-(1 << 63), -5, -5, 0, 7, (1 << 63) - 1]
    assert [EliasFano.build(np.array([k - wide[0] for k in wide], np.uint64)).select(i) + wide[0] for i in range(6)] == wide
    keys, ids = [None, None, *wide], [b"\1\0\0\0" * n for n in (3, 0, 1, 2, 0, 5, 1, 1)]
    raw = pack_block(keys, ids)
    block = Block(raw)
    assert [block.key(i) for i in range(8)] == keys and [bytes(block.ids(i)) for i in range(8)] == ids
    assert [block.span(i) for i in range(3)] == [(0, 3), (3, 3), (3, 4)]
    with pytest.raises(ValueError):
        Block(raw[:-4])
    with pytest.raises(ValueError):
        Block(b"XXXX" + raw[4:])
    # keys and boundaries of 1000 documents of 300 ids in less than 3 bytes a document, ids apart
    assert len(pack_block(list(range(10**12, 10**12 + 1000)), [bytes(1200)] * 1000)) - 1_200_000 < 3000


def test_pieces_and_counts_of_awkward_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows, an empty table and columns of the output's names."""
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from tidemark.llm.sentence_pieces import BLANK, decode_pieces, encode_pieces
    from tidemark.llm.token_counts import count_tokens

    long = spark.createDataFrame([(500, "Some words of a text. " * 50_000, "en", 1)], odd.schema)
    docs = odd.union(odd).union(long)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("ids", "n_pieces", "n_bytes", "n_tokens", "over_limit", "round_trip")])
    rows = docs.select("doc_id", "text").collect()
    got = encode_pieces(docs, vocab("piece_bpe_32k.model"))
    back = collections.Counter((r.doc_id, r.text) for r in decode_pieces(got, vocab("piece_bpe_32k.model")).collect())
    same = {(r.doc_id, r.round_trip) for r in got.collect()}
    assert sum(back.values()) == len(rows) and {(0, True), (500, True)} <= same
    assert all(back[k, (t or "").replace(BLANK, " ")] for k, t in rows if (k, True) in same and (k, False) not in same)
    assert {r.n_pieces for r in got.where("doc_id = 0").collect()} == {0} and encode_pieces(empty(spark), vocab("piece_bpe_32k.model")).count() == 0
    lib = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    want = collections.Counter((k, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 5) for k, t in rows)
    assert collections.Counter(map(tuple, count_tokens(docs, vocab("word_bpe_49k.json"), limit=5).collect())) == want
    assert count_tokens(empty(spark), vocab("word_bpe_49k.json")).count() == 0


def test_other_tokenizer_files_are_refused_or_encoded_whole():
    from tokenizers import Tokenizer

    from tidemark.llm.token_counts import PairCounter
    from tidemark.llm.token_files import WordEncoder

    with pytest.raises(ValueError, match="supported"):
        PairCounter(vocab("byte_bpe_50k.json"))
    own, lib = WordEncoder(vocab("byte_bpe_50k.json")), Tokenizer.from_file(vocab("byte_bpe_50k.json"))
    some = texts(40)
    assert not own.by_word and [np.frombuffer(x, "<u4").tolist() for x in own.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("name", ["op4_decontaminate", "op8_chat_format", "op11_source_divergence", "op12_merkle_manifest", "op13_line_dedup"])
def test_queries_give_what_their_sql_gives(spark, name):
    import duckdb

    from tidemark.llm.queries import oracle_sql, queries

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries()[name](spark, sf)
    cols = sorted(df.columns)
    cur = con.execute(oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = collections.Counter(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and want and collections.Counter(tuple(r[c] for c in cols) for r in df.collect()) == want


def test_token_files_read_back(spark, odd):
    from tokenizers import Tokenizer

    from tidemark.llm.token_files import read_token_blocks, write_token_blocks

    path = vocab("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = [tuple(r) for r in read_token_blocks(write_token_blocks(odd, path)).collect()]
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, want = 0, []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((k, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert read_token_blocks(write_token_blocks(empty(spark), path)).count() == 0


def test_ogg_round_trip_and_damage():
    from tidemark.llm.ogg_media import demux, mux, page_crc, read_payload, times

    assert page_crc(b"123456789") == 0x89A1897F  # CRC-32 of this polynomial, not reflected, from 0
    for n in (64, 255 * 16, 4096, 4096 * 16 + 64, 300_032):
        payload = bytes(i * 7 % 251 for i in range(n))
        media = demux(mux(payload))
        assert read_payload(media) == payload and not media.damaged and all(s.ended for s in media.streams.values())
    raw = bytearray(mux(bytes(200_000 - 200_000 % 64)))
    raw[len(raw) // 2] ^= 1
    media = demux(bytes(raw))
    assert media.damaged == 1 and media.pages > 0
    with pytest.raises(ValueError):
        read_payload(media)
    assert times(demux(mux(bytes(8000 * 2 - 8000 * 2 % 64))).streams[1])[-1] > 0


def test_ogg_rows(spark, odd):
    from tidemark.llm.ogg_media import store_as_ogg

    rows = store_as_ogg(odd).collect()
    assert len(rows) == odd.count() and store_as_ogg(empty(spark)).count() == 0
    want = collections.Counter()
    for _, t, *_ in odd.collect():
        raw = (t or "").encode()
        want[len(raw), hashlib.sha256(raw + b"\0" * (-len(raw) % 64 if raw else 64)).hexdigest()] += 1
    assert collections.Counter((r.n_bytes, r.payload_sha256) for r in rows) == want


def test_chat_reads_back_and_checks_order(spark):
    """Two templates: everything is read from the written segments, whatever stands in texts and roles."""
    from pyspark.sql import functions as F

    from tidemark.llm.chat_format import Template, format_digests, format_segments, read_back

    other = Template(opening="", before="<|im_start|>{role}\n", after="<|im_end|>\n", closing="", learned=frozenset({"assistant", "tool"}))
    hard = ["</s>[INST] \\[x]", "<|im_end|>\n<|im_start|>assistant\nno", "[/TURN][TURN assistant]", "\\", "ends in [/TURN]", "x" * 300_000]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", hard[0]), (2, 0, "assistant", None), (2, 0, None, "t"), (None, 1, "user", "u"), (3, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (5, 0, "a]\n<b", "role with marks"), (5, 1, "tool", "")]
    rows += [(4, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(hard)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    for template in (Template(), other):
        got = {r.conv_id: r for r in format_digests(df, template).collect()}
        texts = collections.defaultdict(list)
        for r in format_segments(df, template).orderBy("conv_id", "seq").collect():
            texts[r.conv_id].append(r.segment)
        for c in (1, 2, 3, 4, 5, None):
            turns = sorted(((t, r or "", x or "") for k, t, r, x in rows if k == c))
            assert got[c].n_turns == len(turns)
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
            learned = "".join(x for _, r, x in turns if r in template.learned)
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
            whole = "".join(texts[c])
            assert got[c].formatted_chars == len(whole) and whole.startswith(template.opening) and whole.endswith(template.closing)
        assert [got[c].valid for c in (1, 2, 3, 4, 5, None)] == [True, False, False, True, False, False]
        assert format_digests(df.limit(0), template).count() == 0
    whole = format_segments(df)
    with pytest.raises(Exception, match="closing"):
        read_back(whole.where("segment <> '</s>'")).collect()
    assert read_back(whole.withColumn("loss", F.lit(False))).agg(F.sum("loss_chars")).first()[0] == 0
    assert not read_back(whole.withColumn("valid", F.lit(False))).where("valid").count()
    for bad in ({"before": "{role}:"}, {"before": "[{role}"}, {"after": ""}, {"after": "\\end"}):
        with pytest.raises(ValueError):
            Template(**bad)


def test_chat_machine_emits_and_checks_each_turn():
    from tidemark.llm.chat_format import BROKEN, Machine, Template

    machine = Machine(Template())
    assert machine.begin() == ("<s>", False, True)
    assert list(machine.step("user", "a[b")) == [("[TURN user]", False, True), ("a\\[b", False, True), ("[/TURN]", False, True)]
    assert machine.at == "user"
    assert [x[1:] for x in machine.step("assistant", "c")] == [(False, True), (True, True), (False, True)]
    assert machine.end() == ("</s>", False, True) and machine.at == "end"
    # out of order: the same segments, never valid again
    machine.begin()
    assert list(machine.step("assistant", "c")) == [("[TURN assistant]", False, False), ("c", True, False), ("[/TURN]", False, False)]
    assert machine.at == BROKEN
    assert [x[2] for r in ("user", "assistant") for x in machine.step(r, "t")] == [False] * 6 and machine.end() == ("</s>", False, False)
    # "end" is no role, a conversation can't end behind a user, and another order is another machine
    machine.begin()
    list(machine.step("user", "")), list(machine.step("assistant", "")), list(machine.step("end", ""))
    assert machine.at == BROKEN
    machine.begin()
    list(machine.step("user", ""))
    assert not machine.end()[2]
    tools = Machine(Template(learned=frozenset({"tool"}), order={"": {"tool"}, "tool": {"tool", "end"}}))
    tools.begin()
    assert [x[1:] for x in tools.step("tool", "x")] == [(False, True), (True, True), (False, True)] and tools.end()[2]


def fewest_bytes(rows, shards):
    """Least bytes that must leave their shard, over every choice of the shards that hold one row more."""
    import itertools

    own = collections.defaultdict(list)
    for size, old in rows:
        own[old].append(size)
    room, more = divmod(len(rows), shards)
    best = None
    for extra in itertools.combinations(range(shards), more):
        cost = sum(sum(sorted(v)[: max(0, len(v) - (room + (s in extra) if s < shards else 0))]) for s, v in own.items())
        best = cost if best is None else min(best, cost)
    return best


def test_resharding_is_even_and_moves_the_fewest_bytes(spark, odd):
    from pyspark.sql import functions as F

    from tidemark.llm.resharding import reshard

    for docs, shards in ((odd, 5), (spark.read.parquet(f"{SF}/documents.parquet"), 24)):
        rows = reshard(docs, F.lit(0) if docs is odd else F.pmod("doc_id", F.lit(7)), shards).collect()
        assert len(rows) == docs.count()
        by = collections.defaultdict(list)
        for r in rows:
            by[r.shard].append(r.slot)
        sizes = [len(by[s]) for s in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert reshard(empty(spark), F.lit(0), 4).count() == 0
    rnd = random.Random(7)
    for shards, olds, n in ((2, 2, 7), (3, 3, 20), (4, 6, 31), (5, 2, 23)):
        texts = ["x" * rnd.choice([0, 1, 2, 7, 8, 15, 16, 60, rnd.randint(0, 200)]) for _ in range(n)]
        df = spark.createDataFrame([(i, t, min(rnd.randrange(olds), rnd.randrange(olds))) for i, t in enumerate(texts)], "doc_id long, text string, old int")
        got = reshard(df, F.col("old"), shards).collect()
        moved = sum(r.size for r in got if r.shard != r.old_shard)
        assert moved == fewest_bytes([(r.size, r.old_shard) for r in got], shards)


def test_language_profiles(spark, odd):
    from tidemark.llm.language_id import DIMENSIONS, Profiles, held_out, letter_vectors, predict, train

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train(docs)
    got = predict(docs, model).select("lang", "lang_pred", "score", held_out("doc_id").alias("h")).where("h").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.9 * len(got) and all(0 <= r.score <= 1 for r in got)
    rows = {r.doc_id: r for r in predict(odd, model).collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[3].lang_pred == "und" and rows[0].score == 0
    assert predict(empty(spark), model).count() == 0 and train(empty(spark)).languages == []
    # the bundled vectors' cosine, worked out letter by letter
    def profile(text):
        v = np.zeros(DIMENSIONS)
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        s = [0, *[ord(c) for c in " ".join(words).replace(" ", "\0")], 0]
        for (a, b, c), n in collections.Counter(zip(s, s[1:], s[2:])).items():
            x, y, z = letter_vectors(np.array([a, b, c])).astype(int)
            v += n**0.5 * np.roll(x, 2) * np.roll(y, 1) * z
        return v

    texts_ = {"a": "the cat and the dog", "b": "le chat et le chien", "c": "кошка и собака, Ёж", "d": "σκύλος 犬と猫"}
    p = Profiles.from_sums({k: profile(t) for k, t in texts_.items()})
    for text in ("the dog and a chat", "собака и Кошка 12", "犬 σκύλος", "x" * 3, "é" * 30_000, "aé" * 30_000):
        v = profile(text)
        cos = [v @ profile(t) / np.linalg.norm(v) / np.linalg.norm(profile(t)) for t in texts_.values()]
        lang, score = p.predict(text)
        assert lang == "abcd"[int(np.argmax(cos))] and score == pytest.approx(max(0, *cos), abs=1e-4)
    tie = Profiles(["m", "n"], np.stack([p.prototypes[0]] * 2))
    assert tie.predict("the dog")[0] == "m"  # the first by name


def test_letters_beyond_latin_have_vectors_of_their_own():
    from tidemark.llm.language_id import grams_of, letter_vectors, vectors_of

    codes = np.array([0, *range(97, 123), *range(0x410, 0x480), *range(0x3B1, 0x3CA), 0x4E2D, 0x6587, 0x1F600])
    v = letter_vectors(codes).astype(int)
    cos = v @ v.T / v.shape[1]
    assert np.abs(cos - np.eye(len(codes))).max() < 0.3
    g, n = grams_of("Жук жук, ΣΣ 中文!")
    assert n.sum() == 13 and {tuple(x >> s & 0x1FFFFF for s in (42, 21, 0)) for x in g.tolist()} >= {(0, 0x436, 0x443), (0, 0x4E2D, 0x6587), (0x4E2D, 0x6587, 0)}
    assert (vectors_of(g) == vectors_of(g[::-1])[::-1]).all()


def test_language_models_and_floors_count_every_labelled_text(spark):
    """Labels that one text in thousands has are learned, and the twenty long texts among tens of thousands have their floor."""
    from pyspark.sql import functions as F

    from tidemark.llm.language_id import ENOUGH, held_out, size_class, train, with_floors

    rare = F.when(F.col("doc_id") % 1000 == 1, F.concat(F.lit("rare"), "doc_id")).otherwise("common")
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.lit("the cat").alias("text")).where(~held_out("doc_id")).withColumn("lang", rare)
    assert docs.count() > 45_000
    model = train(docs)
    assert model.languages == sorted(r[0] for r in docs.select("lang").distinct().collect()) and len(model.languages) > 40
    one = train(docs.limit(1).withColumn("lang", F.lit("a")))
    out = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("a").alias("lang")).where(held_out("doc_id"))
    long = [r[0] for r in out.orderBy("doc_id").limit(ENOUGH).collect()]
    out = out.withColumn("text", F.when(F.col("doc_id").isin(long), F.concat(F.lit("the cat sat on a mat by the door of our old house in town number "), F.repeat(F.lit("q"), F.col("doc_id").cast("int") % 3))).otherwise("the cat"))
    floors = with_floors(one, out).floors
    assert set(floors) == {size_class(n) for n in (one.look("the cat")[2], one.look("the cat sat on a mat by the door of our old house in town number")[2])} and len(floors) == 2
    assert all(v > 0 for v in floors.values()) and floors[size_class(one.look("the cat")[2])] == pytest.approx(0.5, abs=1e-3)


def test_texts_in_no_language_go(spark, odd):
    from tidemark.llm.language_id import in_some_language, train, with_floors

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = with_floors(train(docs), docs)
    assert len(model.floors) >= 2 and max(model.floors.values()) > 0.3
    rnd = random.Random(1)
    noise = [" ".join("".join(rnd.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(300)) for _ in range(20)]
    noise += [" ".join("".join(rnd.choice("абвгдежзиклмноп") for _ in range(6)) for _ in range(300))]
    assert not any(map(model.accepts, noise)) and not model.accepts("12 !?") and not model.accepts(None)
    mine = docs.select("*", *[F_lit.alias(c) for c, F_lit in zip(("score", "lang_pred", "size"), _texts_of("mine", 3))])
    kept = in_some_language(mine, model)
    assert kept.count() >= 0.998 * docs.where("text rlike '[a-z]'").count() and {(r.score, r.lang_pred, r.size) for r in kept.collect()} == {("mine",) * 3}
    assert in_some_language(empty(spark), model).count() == 0 and in_some_language(odd, train(empty(spark))).count() == 0


def _texts_of(value, n):
    from pyspark.sql import functions as F

    return [F.lit(value)] * n


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(i)
    out = []
    for g in groups.values():
        keys = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], len(sets[i]), min(keys) if keys else None) for i in g]
    return sorted(map(str, out))


def near_copies(n=120, seed=5):
    """Groups of edited copies around the threshold, exact copies and a passage that all share."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    shared = " ".join(rnd.choices(words, k=12))
    rows = []
    for g in range(6):
        base = rnd.choices(words, k=rnd.choice([6, 30, 80]))
        for _ in range(n // 6):
            w = list(base)
            for _ in range(rnd.randint(0, 4)):
                w[rnd.randrange(len(w))] = rnd.choice(words)
            if rnd.random() < 0.2:
                w = w[: max(1, len(w) - rnd.randint(0, 6))]
            rows.append((len(rows), " ".join(w) + (f" {shared}" if g % 2 else "")))
    return rows


def test_jaccard_join_is_exact(spark, odd):
    from tidemark.llm.jaccard_join import link_components

    for rows in (near_copies(), [(r.doc_id, r.text) for r in odd.collect()]):
        df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, node string")
        got = link_components(df).drop("row").collect()
        assert sorted(str(tuple(r)) for r in got) == brute_components(rows)
    assert link_components(empty(spark)).count() == 0


def test_jaccard_join_of_a_large_group_of_near_copies(spark):
    """4,200 edited copies of one text, many of them just under the similarity: the same components as all pairs give."""
    from tidemark.llm.jaccard_join import link_components

    rnd, n = random.Random(11), 4200
    words = [f"w{i}" for i in range(3000)]
    base, rows = rnd.choices(words, k=60), []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 2, 3, 4])):
            w[rnd.randrange(len(w))] = rnd.choice(words)
        rows.append((i, " ".join(w)))
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    number = {g: i for i, g in enumerate(sorted({g for s in sets for g in s}))}
    shared = np.zeros((n, n), np.float32)
    for lo in range(0, len(number), 8000):
        x = np.zeros((n, 8000), np.float32)
        for i, s in enumerate(sets):
            for g in s:
                if lo <= number[g] < lo + 8000:
                    x[i, number[g] - lo] = 1
        shared += x @ x.T
    size = np.array([len(s) for s in sets])
    linked = 100 * shared >= 80 * (size[:, None] + size[None, :] - shared)
    comp = np.arange(n)
    while True:
        new = np.where(linked, comp[None, :], n).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    got = {r.doc_id: r.component_id for r in link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 1 < len(set(comp.tolist())) and got == dict(enumerate(comp.tolist()))


def test_jaccard_nodes_of_one_64_bit_digest_come_apart(spark):
    from tidemark.llm.jaccard_join import apart, set_nodes

    sets = spark.createDataFrame([(i, i, i % 2, i // 4, 5, 1, 0, [i], [i]) for i in range(8)], "doc_id long, row long, node long, high long, n long, l int, central int, bits array<long>, prefix array<long>")
    nodes = set_nodes(sets, "doc_id")
    assert {r.node: (r.lo, r.hi) for r in nodes.collect()} == {0: (0, 1), 1: (0, 1)}
    new = apart(sets, nodes)
    assert new.columns == sets.columns and new.select("node").distinct().count() == 4
    assert set_nodes(new, "doc_id").where("lo < hi").count() == 0


def test_components_of_chains(spark):
    from tidemark.llm.common import Staged
    from tidemark.llm.graph import components

    links = [(i, i + 1) for i in range(0, 40)] + [(101, 100), (100, 102)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long"), Staged("test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_resharding_writes_whole_rows_by_place(spark, odd, tmp_path):
    """Null and repeated keys and columns named shard and slot: each row once in the written shards."""
    from pyspark.sql import functions as F

    from tidemark.llm.resharding import reshard, reshard_and_rewrite, rewrite_shards

    docs = odd.union(odd).union(spark.createDataFrame([(None, "x" * i, None, i) for i in range(20)], odd.schema))
    docs = docs.select("*", F.lit("a").alias("shard"), F.lit("b").alias("slot"), F.lit("c").alias("row"), F.lit("d").alias("order"))
    back, touched = rewrite_shards(reshard(docs, F.lit(0), 3), str(tmp_path / "shards"))
    assert sorted(map(str, back.select("row.*").collect())) == sorted(map(str, docs.collect())) and touched == {0, 1, 2}
    places = collections.Counter((r.shard, r.slot) for r in back.select(back.shard, back.slot).collect())
    assert len(places) == docs.count() and {s for s, _ in places} == {0, 1, 2}
    cols = ["doc_id", "size", "text_crc32"]
    want = collections.Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert collections.Counter(map(tuple, reshard_and_rewrite(docs, F.lit(0), 3).select(cols).collect())) == want
    still = reshard_and_rewrite(odd, F.lit(0), 1).collect()  # nothing moves, nothing is written
    assert len(still) == odd.count() and {r.shard for r in still} == {0}


def test_suffix_dedup_leaves_no_repeated_passage(spark, odd):
    from tidemark.llm.suffix_dedup import LEAST, cut_repeats, joined_spans, repeated_spans

    rnd = random.Random(2)
    words = [f"v{i}" for i in range(5000)]
    passages = [rnd.choices(words, k=k) for k in (50, 51, 70, 130)]
    rows = []
    for i in range(60):
        w = rnd.choices(words, k=rnd.randint(10, 200))
        if i % 2:
            at = rnd.randint(0, len(w))
            w[at:at] = passages[i % 4 if i % 4 < 4 else 0]
        rows.append((i, " ".join(w)))
    rows += [(60, rows[1][1]), (61, None), (62, ""), (63, rows[3][1])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, pos string")
    spans = repeated_spans(df)
    gone = collections.defaultdict(set)
    for r in joined_spans(spans).collect():
        assert r.n_words == r.end - r.begin and r.doc_id not in r.kept_ids
        gone[r.doc_id] |= set(range(r.begin, r.end))
    left, ever = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in rows:
        w = (t or "").split()
        for k in range(len(w) - LEAST + 1):
            g = tuple(w[k : k + LEAST])
            ever[g].add(i)
            if not set(range(k, k + LEAST)) <= gone[i]:
                left[g].add(i)
    shared = {g for g, d in ever.items() if len(d) > 1}
    assert shared and all(len(left[g]) == 1 for g in shared)  # once, and not nowhere
    assert all(not gone[i] for i in range(0, 60, 2))  # clean documents stay as they are
    cut = {r.doc_id: r.text for r in cut_repeats(df, spans).collect()}
    assert cut[0] == rows[0][1] and 60 not in cut and 61 in cut and len(cut[5].split()) == len(rows[5][1].split()) - len(gone[5])
    assert repeated_spans(empty(spark)).count() == 0 and repeated_spans(odd.select("doc_id", "text")).count() >= 0


def test_suffix_dedup_compares_beyond_neighbours(spark):
    """Texts that hold the right part of a passage alone sort between two that hold all of it."""
    from tidemark.llm.suffix_dedup import LEAST, joined_spans, minimisers, repeated_spans

    rnd = random.Random(5)
    word = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = word(LEAST)
    while not 15 <= minimisers(" ".join(passage))[1][0] <= 25:
        passage = word(LEAST)
    right = passage[minimisers(" ".join(passage))[1][0] :]
    rows = [(1, " ".join(word(30) + passage + word(30))), (3, " ".join(word(30) + passage + word(30)))]
    rows += [(i, " ".join(word(5) + right + word(60))) for i in range(10, 70)]
    got = joined_spans(repeated_spans(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert [tuple(r) for r in got] == [(3, 30, 80, 50, [1])]


def test_suffix_dedup_is_the_same_in_parts(spark, monkeypatch):
    """A frequent line between contexts that others share on one side: parts give what one group gives."""
    from tidemark.llm import suffix_dedup

    rnd = random.Random(6)
    word = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    line, left, right = word(20), [word(35) for _ in range(7)], [word(35) for _ in range(7)]
    rows = [(7 * i + j if i + j else None, " ".join(left[i] + line + right[j])) for i in range(7) for j in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda: sorted(map(str, suffix_dedup.joined_spans(suffix_dedup.repeated_spans(df)).collect()))
    whole = found()
    monkeypatch.setattr(suffix_dedup, "PART", 3)
    monkeypatch.setattr(suffix_dedup, "SLICE", 3)
    assert found() == whole and len(whole) >= 42


def test_cut_repeats_keeps_other_columns_and_rows_of_a_key(spark):
    """A user's columns of any name, null keys and texts, and a key that repeats with another text."""
    from tidemark.llm.suffix_dedup import cut_repeats, repeated_spans

    rnd = random.Random(8)
    word = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage = word(60)
    rows = [(1, passage + " " + word(5), "a"), (2, "x " + passage, "b"), (2, word(80), "c"), (None, word(3) + " " + passage, "d"), (3, None, "e"), (4, passage, "f")]
    df = spark.createDataFrame([(*r, r[2], r[2], r[2], r[2]) for r in rows], "doc_id long, text string, sk string, spans string, key string, hash string, own string")
    got = {r.sk: r for r in cut_repeats(df, repeated_spans(df)).collect()}
    assert set(got) == set("abcde") and all(r.spans == r.key == r.hash == r.own == k for k, r in got.items())
    assert got["a"].text == rows[0][1] and got["b"].text.split() == ["x"] and got["c"].text == rows[2][1] and len(got["d"].text.split()) == 3 and got["e"].text is None


def test_decontamination_sees_new_parameters(spark, odd):
    from tidemark.llm.decontaminate import contaminated, drop_contaminated

    bench = spark.createDataFrame([(1, "A train leaves the town at 7 and 7 men walk for 3 km while Anna waits at home for 3 hours today"), (2, "too short to tell"), (3, None)], "item_id long, text string")
    same = "Before it. A train leaves the town at 9 and 9 men walk for 40 km while Berta waits at home for 40 hours today. After"
    unlike = "A train leaves the town at 9 and 8 men walk for 40 km while Berta waits at home for 41 hours today"
    docs = spark.createDataFrame([(1, same, "x"), (2, unlike, "x"), (3, "nothing of the kind is said in this text at all", "x"), (4, None, "x"), (1, same, "y"), (None, same, "z")], "doc_id long, text string, words__ string")
    got = {(r.doc_id, r.item_id): r for r in contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (None, 1)} and got[1, 1].n_slots >= 3
    assert sorted(str(r.doc_id) for r in drop_contaminated(docs, bench).collect()) == ["2", "3", "4", "None"]
    assert contaminated(odd, bench).count() == 0 and contaminated(empty(spark), bench).count() == 0
    assert drop_contaminated(odd, bench.limit(0)).count() == odd.count()


def test_decontamination_sees_names_anywhere_and_short_items(spark):
    """Names that open a sentence or line or follow a name; items that are short or almost all numbers."""
    from tidemark.llm.decontaminate import contaminated

    question = "{0} has 3 apples and gives them away today.\n{0} then buys 2 pears. {1} {2} eats one of them. How many are left to {0} now?"
    items = [(1, question.format("Tom", "Anna", "Maria")), (2, "What is seven times nine?"), (3, "1 2 3 4 5 6 7 8 9 10 11 12 plus one"), (4, "Yes"), (5, " ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    new = question.format("Robert", "Clara", "Sofia").replace("3", "5")
    docs = [(1, "Before it. " + new), (2, "so what is seven times nine? Who knows"), (3, "0 " + items[2][1] + " more"), (4, "yes"), (5, "He said yes to all of it"), (6, "what is seven times eight?"), (7, "2 2 3 4 5 6 7 8 9 10 11 12 plus one"), (8, new.lower().replace("robert", "Tom")), (9, None), (10, "")]
    got = sorted((r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect())
    assert [x for x in got if x[0] != 8] == [(1, 1), (2, 2), (3, 3), (4, 4)]


def test_pipeline_stages_on_awkward_and_real_rows(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(10_000, None, "en", "s", 0), (10_001, "", "en", "s", 0), (10_002, "12 34 !!", None, "s", 8), (10_003, "This is the text of a small document.", None, None, None)]
    at = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    for name, stage in corpus_pipeline.STAGES:
        before, at = at, stage(spark, at, SF)
        if name != "sentence_pieces":
            assert at.columns == docs.columns
        if name == "language_id":
            ids = {r[0] for r in at.select("doc_id").collect()}
            assert 10_003 in ids and not ids & {10_000, 10_001, 10_002} and len(ids) == docs.count() + 1
        if name == "jaccard_join":
            kept = sorted(r[0] for r in at.select("doc_id").collect())
            want = {c for c in re.findall(r", (\d+)\)", " ".join(brute_components([(r.doc_id, r.text) for r in before.collect()])))}
            assert set(map(str, kept)) == want
    assert at.where("not round_trip").count() == 0
    assert corpus_pipeline.drop_benchmark(spark, docs.limit(0), SF).count() == 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_contaminated_rows_go_by_key_and_text(spark):
    """A contaminated row goes with a null key too, a clean text stays whatever else has its key, rows that repeat go or stay together."""
    import corpus_pipeline

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    clean = "Quite another text of some words that nobody asked about at all, in the garden."
    rows = [(1, f"Before it. {item} After it.", "bad"), (None, f"Look: {item}", "bad"), (2, item, "bad"), (2, item, "bad"), (2, clean, "good"), (None, clean, "good"), (3, None, "good"), (None, None, "good"), (4, "", "good"), (5, clean, "good"), (5, clean, "good")]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, what, "k") for k, t, what in rows], "doc_id long, text string, lang string, source string, n_chars long, bad__ string, key string")
    got = corpus_pipeline.drop_benchmark(spark, docs, SF)
    assert got.columns == docs.columns
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter((k, t) for k, t, what in rows if what == "good")


def test_language_stage_leaves_columns_of_any_name(spark):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"score": F.lit("mine"), "lang_pred": F.lit(7)})
    got = corpus_pipeline.keep_languages(spark, docs, SF)
    assert got.schema == docs.schema and {(r.score, r.lang_pred) for r in got.collect()} == {("mine", 7)}


def test_pieces_that_may_follow_are_tried_few_times():
    """Words of BPE models: the path of least weight is found without weighing all arcs, and is the library's and merging's."""
    import public_tokenizers
    import sentencepiece

    from tidemark.llm.sentence_pieces import PieceTransducer

    path = public_tokenizers.path("piece_bpe_32k.model")
    machine, library = PieceTransducer(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(12)
    syllables = ["an", "ter", "qu", "x", "ß", "tion", "zz", "aaaa", "ing", "é", "漢", "‍", "0", "--", "Str", "ough"]
    words = ["".join(rnd.choices(syllables, k=rnd.randrange(1, 9))) for _ in range(3000)]
    for w in words:
        assert np.frombuffer(machine.encode(w), "<i4").tolist() == library.encode(w), w
        assert [machine.pieces[k][0] if k >= 0 else chr(-2 - k) for k in machine.shortest("▁" + w)] == machine.merge("▁" + w)[0], w
    assert len(machine.pairs) < 1700  # 1,970 where all arcs are weighed


def test_new_words_go_to_the_library_in_few_texts():
    import public_tokenizers

    from tidemark.llm.token_files import WordEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, texts = WordEncoder(path), []
    library = encoder.tokenizer

    class Counted:
        def encode_batch_fast(self, some, **options):
            texts.extend(some)
            return library.encode_batch_fast(some, **options)

    encoder.tokenizer = Counted()
    rnd = random.Random(5)
    docs = [" ".join("".join(rnd.choices("abcdefghié", k=rnd.randrange(2, 12))) for _ in range(400)) + "." for _ in range(10)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(docs)] == [library.encode(d, add_special_tokens=False).ids for d in docs]
    assert len(texts) < 15
