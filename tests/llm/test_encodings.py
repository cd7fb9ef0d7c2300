import random
import time
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lumenlog.llm import chunks, flac, media, queries, segmentations, token_counts, token_files
from lumenlog.llm.pieces import pieces
from lumenlog.llm.shared import shared_dir

MODEL = "piece_bpe_32k.model"


@pytest.mark.parametrize("width", [1, 7, 12, 15, 16, 17, 32])
def test_packing(width):
    ids = np.random.default_rng(width).integers(0, 1 << width, 1001, dtype=np.uint64).astype("<u4")
    held = token_files.pack_ids(ids, width)
    assert len(held) == -(-1001 * width // 8)
    assert (token_files.unpack_ids(held, width, 0, 1001) == ids).all()
    assert (token_files.unpack_ids(held, width, 333, 700) == ids[333:700]).all()
    assert token_files.id_width(49_408) == 16 and token_files.id_width(2) == 1 and token_files.id_width(1) == 1


def test_chunks_encode_like_whole_texts():
    e = token_files.encoder("word_bpe_49k.json", 49_408)
    random.seed(1)
    letters = "aAbé.,'sS \n\t<|>İΣ́ 1一"
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 60))) for _ in range(3000)]
    texts += ["", " ", "<|endoftext|>. <|EndOfText|> x", "don't. I'LL,", "x" * 5000 + "."]
    for t, ids, whole in zip(texts, e(texts), e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == whole.ids, t


def test_token_files(spark, odd_docs, no_docs):
    path = f"{shared_dir(spark)}/t"
    token_files.write_token_files(odd_docs, path, "word_bpe_49k.json", 49_408, 2, block_ids=64)
    got = token_files.read_token_files(spark, path).collect()
    e, start = token_files.encoder("word_bpe_49k.json", 49_408), 0
    rows = sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for doc_id, text in rows:
        ids = np.array([*e.tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert [r.ids for r in token_files.read_ids(spark, path, 9).collect()] == [[*e.tokenizer.encode("one two", add_special_tokens=False).ids, 2]]
    assert [r.ids for r in token_files.read_ids(spark, path, 7).orderBy("place").collect()] == [[*e.tokenizer.encode(odd_docs.filter("doc_id = 7").first().text, add_special_tokens=False).ids, 2]] * 2
    empty = f"{shared_dir(spark)}/e"
    token_files.write_token_files(no_docs, empty, "word_bpe_49k.json", 49_408, 2)
    assert token_files.read_token_files(spark, empty).count() == 0


def brute_count(table, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        found = [(best[s][0] + table.score[word[s:end]], best[s][1] - 1) for s in range(max(0, end - 16), end) if word[s:end] in table.score]
        if word[end - 1] not in table.score:
            k = len(word[end - 1].encode())
            found.append((best[end - 1][0] + k * table.BYTE, best[end - 1][1] - k))
        best.append(max(found))
    return -best[-1][1]


def test_token_counts(spark, odd_docs, no_docs):
    table = pieces(MODEL)
    got = sorted(map(tuple, token_counts.token_counts(odd_docs, MODEL).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        words = (r.text or "").encode().split()
        want.append((r.doc_id, len(words), sum(brute_count(table, "▁" + w.decode()) for w in words)))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, MODEL).count() == 0


def test_trie_that_is_full_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "NODES", 5)
    c = token_counts.TrieCounter(pieces(MODEL))
    assert [c(w) for w in ("hello", "help", "hello", "w" * 100)] == [brute_count(pieces(MODEL), "▁" + w) for w in ("hello", "help", "hello", "w" * 100)]


def test_segmentations(spark, odd_docs, no_docs):
    model = pieces(MODEL).model
    by_id = {}
    for r in segmentations.encoded(odd_docs, MODEL, k=3).collect():
        by_id.setdefault(r.doc_id, []).append(r)
    for r in odd_docs.collect():
        ids = np.array(model.encode(r.text or ""), "<u4")
        held = by_id[r.doc_id][0]
        assert (held.n_pieces, held.ids_crc32, held.decoded) == (len(ids), zlib.crc32(ids.tobytes()), True)
        assert 1 <= len(held.samples) <= 3 and [s["rank"] for s in held.samples] == list(range(1, len(held.samples) + 1))
        assert [s.perturbed for s in held.samples] == sorted((s.perturbed for s in held.samples), reverse=True)
    assert by_id[7][0] == by_id[7][1]
    assert segmentations.encoded(no_docs, MODEL).count() == 0


def test_query_opens_sets_of_later_paths(spark):
    rows = queries.op4_segmentations(spark, "/root/testdata/sf0.001").collect()
    assert {len(r.samples) for r in rows if r.n_pieces >= 30} == {4}
    assert all(len({x.ids_crc32 for x in r.samples}) == len(r.samples) for r in rows)


def test_full_sampler_keeps_what_comes_often(monkeypatch):
    texts = [[f"the station of {a}{b}x{i} é漢 and the {b}".encode() for b in "defg"] for i, a in enumerate("abcdefgh")]
    rows = np.arange(4)
    want = [segmentations.Sampler(pieces(MODEL), 4, 3)(t, rows) for t in texts]
    monkeypatch.setattr(segmentations, "UNITS", 32)
    s = segmentations.Sampler(pieces(MODEL), 4, 3)
    learned = []
    monkeypatch.setattr(s, "_learn", lambda keys, learn=s._learn: (learned.extend(keys), learn(keys)))
    for t, (ids, samples) in zip(texts, want):
        got = s(t, rows)
        assert [x.tolist() for x in got[0]] == [x.tolist() for x in ids] and got[1] == samples
    assert learned.count(b" station") == 1 and len(s.number) <= 32


def test_searches_of_many_texts_walk_behind_their_cuts_only(monkeypatch):
    texts = [f"the station of {a}{b} and the {b} é漢 in a long row of words, {i} of them".encode() for i, (a, b) in enumerate(zip("abcdefgh" * 5, "defghijk" * 5))] + [b"", b"a"]
    one, all_ = segmentations.Sampler(pieces(MODEL), 4, 3), segmentations.Sampler(pieces(MODEL), 4, 3)
    want = [one([t], np.array([i]))[1][0] for i, t in enumerate(texts)]
    walked = []
    monkeypatch.setattr(all_.lattice, "walk", lambda starts, *a, walk=all_.lattice.walk: (walked.append(len(starts)), walk(starts, *a))[1])
    assert all_(texts, np.arange(len(texts)))[1] == want
    assert len(walked) == 4 and max(walked[1:]) < walked[0]


def test_full_table_keeps_what_comes_often():
    asked = []
    table, hasher = chunks.Table(lambda w: asked.append(w) or len(w), np.int64, 12), chunks.Hasher()
    for i in range(9):
        words = [b"often", b"x" * (i + 1), b"again", b"y" * (i + 2)]
        assert table(hasher([b" ".join(words)])).tolist() == list(map(len, words))
    assert asked.count("often") == asked.count("again") == 1 and len(table.number) <= 12


def test_samples_follow_the_distribution():
    """First samples come as often as their probabilities say, samples of a row are distinct, and all segmentations come when k is large."""
    s = segmentations.Sampler(pieces(MODEL), 2, 5)
    n = 4000
    text = "thestation"
    _, found = s([text.encode()] * n, np.arange(n))
    times, chance = {}, {}
    for rows in found:
        assert len({r[2] for r in rows}) == len(rows)
        times[rows[0][2]] = times.get(rows[0][2], 0) + 1
        for r in rows:
            chance[r[2]] = np.exp(r[3])
    for crc, k in times.items():
        assert abs(k / n - chance[crc]) < 4 * np.sqrt(chance[crc] / n) + 1e-3
    every = segmentations.Sampler(pieces(MODEL), 200, 5)([b"ab"], np.arange(1))[1][0]
    assert abs(sum(np.exp(r[3]) for r in every) - 1) < 1e-5 and {r[5] for r in every} == {0.0}


def all_segmentations(table, text):
    """Ids of every segmentation of a word with a blank's sign before it -> log of its share."""
    out = []

    def go(at, ids, score):
        if at == len(text):
            out.append((ids, score))
        elif text[at] not in table.score:
            more = table.spelled(text[at])
            go(at + 1, (*ids, *more), score + table.BYTE * len(more))
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in table.score:
                go(end, (*ids, table.id[text[at:end]]), score + table.score[text[at:end]])

    go(0, (), 0.0)
    whole = np.logaddexp.reduce([s for _, s in out])
    return [(zlib.crc32(np.array(ids, "<u4").tobytes()), s - whole) for ids, s in out]


def test_samples_are_all_segmentations_of_short_words():
    table = pieces(MODEL)
    words = ["the", "abc", "train", "station", "in", "hello", "\u4e2d", "x\u00e9y", "aaaa", "inter", "over", "A", "Wort", "ende", "zu", "q.", "don't", "1234"]
    for w in words:
        want = sorted(all_segmentations(table, "\u2581" + w))
        got = segmentations.Sampler(table, len(want) + 3, 5)([w.encode()], np.arange(1))[1][0]
        assert [r[2] for r in sorted(got, key=lambda r: (r[2], r[3]))] == [c for c, _ in want], w
        assert np.allclose(sorted(r[3] for r in got), sorted(s for _, s in want), atol=2e-6), w


def test_pieces_lie_over_any_place_of_a_long_word():
    s, piece = segmentations.Sampler(pieces(MODEL), 1, 5), max((p for p in pieces(MODEL).score if p.isascii()), key=lambda p: (len(p), p))
    n, word = len(piece), "x" * 43 + piece * 30
    s([word.encode()], np.arange(1))
    jumps = {(p, int(j)) for p in range(s.lattice.n) for j in s.lattice.jump[s.lattice.first[p] : s.lattice.first[p + 1]]}
    assert n > 8 and s.lattice.n == len(word) + 1 and all((44 + n * i, n) in jumps for i in range(30))


def thue_morse(n):
    a = "ab"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_that_polynomials_mix_up():
    """Words of 4,096 letters that a sum of powers modulo 2**64 can't tell apart."""
    a, b = thue_morse(4096)
    spans = chunks.Hasher()([f"{a} {b} {a}".encode()])
    assert spans.key[0] != spans.key[1] and spans.key[0] == spans.key[2]
    table = pieces(MODEL)
    assert chunks.Table(token_counts.TrieCounter(table), np.int64)(spans).tolist() == [brute_count(table, "\u2581" + w) for w in (a, b, a)]
    e = token_files.encoder("word_bpe_49k.json", 49_408)
    for t, ids in zip((a, b), e([a, b])):
        assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
    ids = segmentations.Sampler(table, 1, 5)([a.encode(), b.encode()], np.arange(2))[0]
    assert [x.tolist() for x in ids] == [table.model.encode(a), table.model.encode(b)]


def test_words_of_one_hash_stay_apart(monkeypatch):
    monkeypatch.setattr(chunks.Hasher, "keys", staticmethod(lambda data, start, stop: np.zeros(len(start), np.uint64)))
    table = pieces(MODEL)
    words = ["hello", "help", "w" * 300, "w" * 299 + "v", "hello"]
    spans = chunks.Hasher()([" ".join(words).encode()])
    assert chunks.Table(token_counts.TrieCounter(table), np.int64)(spans).tolist() == [brute_count(table, "\u2581" + w) for w in words]


CASES = [b"a" * 64, bytes(64), bytes(range(256)) * 20, b"hello world " * 700, bytes([0, 255] * 3000), (b"\0" * 300 + b"\xff") * 30, b"\x80" * 500 + b"\x81" + b"\x80" * 500 + b"\x00"]


@pytest.mark.parametrize("lpc", [0, 1, 4, 8])
def test_flac_round_trip(lpc):
    noise = np.random.default_rng(0).integers(0, 256, 9000, dtype=np.uint8).tobytes()
    streams = [flac.encode(c, lpc) for c in [*CASES, noise]]
    assert [b"".join(x) for x in flac.decode_all(streams)] == [*CASES, noise]


def test_flac_finds_changed_bytes():
    held = flac.encode(CASES[3])
    frames = flac._opened(held)["starts"][0]  # sizes and rates before that are for players; the MD5 stands at 26
    for i in [26, 41, *range(frames, len(held), 41)]:
        broken = bytearray(held)
        broken[i] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_all([bytes(broken)])
    with pytest.raises(flac.FlacError):
        flac.decode_all([held[:-3]])


def test_linear_predictors_are_stored():
    streams = [flac.encode(c, media.LPC_ORDER) for c in CASES]
    wave = (128 + 90 * np.sin(np.arange(5000) / 9)).astype(np.uint8).tobytes()
    kinds = [flac._Reader(s, 8 * (s.index(b"\xff\xf8") + 8)).take(8) >> 1 for s in (flac.encode(wave, media.LPC_ORDER),)]
    assert kinds[0] >= 32 and [b"".join(x) for x in flac.decode_all([*streams, flac.encode(wave, media.LPC_ORDER)])] == [*CASES, wave]


def test_media(spark, odd_docs, no_docs):
    import hashlib

    got = {(r.doc_id, r.n_bytes): r for r in media.media_features(odd_docs).collect()}
    for r in odd_docs.collect():
        data = (r.text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        g = got[r.doc_id, len(data)]
        assert (g.payload_bytes, g.payload_sha256, g.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5, 61].media_sha256 == got[7, 61].media_sha256 and got[5, 61].feature == got[7, 61].feature
    assert media.media_features(no_docs).count() == 0
    blocks = media.decoded(media.encoded(odd_docs.filter("doc_id = 4"))).first().blocks
    assert media.samples([b.asDict() for b in blocks], 4090, 4102) == odd_docs.filter("doc_id = 4").first().text.encode()[4090:4102]


def test_hashes_tell_words_apart():
    spans = chunks.Hasher()([b"a b ab ba a", b"", b"b a"])
    assert len(set(spans.key.tolist())) == 4 and spans.first.tolist() == [0, 5, 5, 7] and spans.text(2) == "ab"


@pytest.mark.parametrize("word", ["ab" * 200_000, "éx9" * 100_000, "QUJD/x+9" * 50_000])
def test_counts_of_very_long_words(word):
    """Linear in the word's length, and the same as by the plain recurrence on a part of it."""
    c, began = token_counts.TrieCounter(pieces(MODEL)), time.time()
    assert c(word) > 0 and time.time() - began < 20
    assert [c(word[:n]) for n in (40, 47, 48, 49, 3000)] == [brute_count(pieces(MODEL), "▁" + word[:n]) for n in (40, 47, 48, 49, 3000)]
