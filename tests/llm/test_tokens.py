"""Operators 2, 6, 8 and 10: media, packing, token files and token counts."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from orebody.llm import encoder, flac, packing, tokens, transducer

vocabularies = pytest.importorskip("public_tokenizers")
BPE, PIECES = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def plain_decode(stream):
    """A FLAC decoder that reads bit by bit: 8-bit mono, fixed and linear predictors, Rice partitions."""
    at, last = 4, False
    assert stream[:4] == b"fLaC"
    while not last:
        last, size = bool(stream[at] & 128), int.from_bytes(stream[at + 1 : at + 4], "big")
        if stream[at] & 127 == 0:
            total = int.from_bytes(stream[at + 14 : at + 22], "big") & ((1 << 36) - 1)
        at += 4 + size
    out = []
    while len(out) < total:
        number = stream[at + 4]
        head = 4 + (1 if number < 128 else 8 - (number ^ 255).bit_length()) + 1
        bits, pos = "".join(f"{b:08b}" for b in stream[at + head : at + head + 600]), 8

        def take(n, signed=False):
            nonlocal pos
            v = int(bits[pos : pos + n], 2) if n else 0
            pos += n
            return v - (1 << n) if signed and n and v >> (n - 1) else v

        kind = int(bits[1:7], 2)
        order = kind - 8 if kind < 32 else kind - 31
        x = [take(8, True) for _ in range(order)]
        if kind < 32:
            coef, shift = flac.FIXED[order], 0
        else:
            precision, shift = take(4) + 1, take(5)
            coef = [take(precision, True) for _ in range(order)]
        assert take(2) == 0 and take(4) == 0
        k = take(4)
        while len(x) < flac.BLOCK:
            q = 0
            while not take(1):
                q += 1
            u = q << k | take(k)
            x.append((u >> 1 ^ -(u & 1)) + (sum(c * x[-1 - j] for j, c in enumerate(coef)) >> shift))
        out += x
        at += head + (pos + 7) // 8 + 2
    return bytes(v + 128 for v in out)


def payloads():
    rng = random.Random(6)
    return [flac.pad(x) for x in (b"", b"a", "Ein Text mit Ümlauten, und mehr. ".encode() * 40, bytes(rng.randrange(256) for _ in range(960)), b"\x00" * 192 + b"\xff" * 192, bytes([0, 255] * 300))]


def test_flac_round_trip_and_plain_decoder():
    media = flac.encode(payloads())
    got, starts = flac.decode(media)
    assert got == payloads() == [plain_decode(m) for m in media]
    assert [s.tolist() for s in starts] == [list(range(0, len(p), flac.BLOCK)) for p in payloads()]
    assert flac.encode([]) == [] and flac.decode([]) == ([], [])


def test_flac_without_seek_points_and_with_damage():
    payload = payloads()[2]
    media = flac.encode([payload])[0]
    frames = len(payload) // flac.BLOCK
    bare = b"fLaC\x80" + media[5:42] + media[42 + 4 + 18 * frames :]
    assert flac.decode([bare])[0] == [payload]
    for place in (len(media) - 1, len(media) - 60, 42 + 4 + 18 * frames + 3):
        broken = bytearray(media)
        broken[place] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(broken)])


def test_media_digests(edge, empty, edge_rows):
    got = sorted((tuple(r) for r in flac.media_digests(edge).collect()), key=key)
    want = []
    for row in edge_rows:
        text = (row[1] or "").encode()
        p = flac.pad(text)
        m = flac.encode([p])[0]
        want.append((row[0], len(text), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest()))
    assert [r[:7] for r in got] == sorted(want, key=key)
    assert flac.media_digests(empty).collect() == []


def test_pcm_blocks(spark, edge):
    small = edge.where("length(text) < 5000 OR text IS NULL")
    blocks = flac.pcm_blocks(flac.to_media(small)).where("doc_id = 6").orderBy("sample_offset").collect()
    text = next(r["text"] for r in edge.collect() if r["doc_id"] == 6)
    assert b"".join(bytes(b["pcm"]) for b in blocks) == flac.pad(text.encode())
    assert [b["sample_offset"] for b in blocks] == [flac.BLOCK * i for i in range(len(blocks))]


def test_encoder_is_the_library(library):
    rng = random.Random(2)
    odd = ["", " a", "a ", "a  b", "a \n b", "x\n y", "a.\nB", "foo <|endoftext|> bar", "a<|endoftext|>.b", "it's 's", "a\xa0b　c", "é ü. x÷.", "\n\na", "a\r\nb", "a\x1c b"]
    odd += ["".join(rng.choice(["a", "b", " ", "'", ".", ",", "\n", "é", "×", "\xa0", "…", "<|endoftext|>", "1"]) for _ in range(rng.randrange(25))) for _ in range(3000)]
    import pyarrow as pa

    from orebody.llm.common import utf8

    ids, offsets = encoder.Encoder(BPE)(*utf8(pa.array(odd)))
    for i, text in enumerate(odd):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_encoder_memory_begins_anew(library, monkeypatch):
    import pyarrow as pa

    from orebody.llm.common import utf8

    monkeypatch.setattr(encoder, "PIECES", 50)
    own, rng = encoder.Encoder(BPE), random.Random(4)
    for _ in range(5):
        texts = [" ".join(str(rng.randrange(10**6)) + "x" for _ in range(40)) for _ in range(3)]
        ids, offsets = own(*utf8(pa.array(texts)))
        assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(3)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_with_one_hash_keep_their_own_ids(library, monkeypatch):
    import pyarrow as pa

    from orebody.llm.common import utf8

    rng = random.Random(8)
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(2048))
    texts = [word, word.translate(str.maketrans("ab", "ba")), word[:1024]] + [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 30))) for _ in range(60)) for _ in range(20)]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    plain = encoder.lane_hash
    for mask in ((1 << 64) - 1, 31):
        monkeypatch.setattr(encoder, "lane_hash", lambda *a, mask=mask: plain(*a) & np.uint64(mask))
        own = encoder.Encoder(BPE)
        for _ in range(2):
            ids, offsets = own(*utf8(pa.array(texts)))
            assert [ids[offsets[i] : offsets[i + 1]].tolist() for i in range(len(texts))] == want


def test_token_files(spark, edge, empty, edge_rows, library, tmp_path):
    got = [tuple(r) for r in tokens.dataset_digests(edge, BPE, 0).collect()]
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [0]) for r in edge_rows]
    want = sorted(((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids), key=key)
    assert sorted(((i, n, c) for i, _, n, c in got), key=key) == want
    at = 0
    previous = (-1,)
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        here = (0,) if i is None else (1, i)
        assert previous <= here or previous == (-1,)
        at, previous = at + n, here
    assert tokens.dataset_digests(empty, BPE).collect() == []


def test_token_file_format(spark, corpus, library, tmp_path):
    docs, _ = corpus
    shards = tokens.write_dataset(docs, str(tmp_path / "set"), BPE, 0)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    base = 0
    for s in shards:
        name = str(tmp_path / "set" / f"{s['shard']:06d}")
        ids, off, doc = np.memmap(name + ".ids", "<u2", "r"), np.memmap(name + ".off", "<u8", "r"), np.memmap(name + ".doc", "<i8", "r")
        assert s["first_id"] == base and len(off) == len(doc) + 1 and off[-1] == len(ids)
        d = int(doc[0])
        assert ids[: int(off[1])].tolist() == library.encode(texts[d], add_special_tokens=False).ids + [0]
        base += len(ids)
    back = tokens.read_dataset(spark, str(tmp_path / "set"), with_ids=True).where("doc_id = 3").first()
    assert back["ids"] == library.encode(texts[3], add_special_tokens=False).ids + [0]


def check_packing(rows, limits):
    """rows: (example, start, length, sequence, offset)."""
    by_sequence, by_example = {}, {}
    for e, start, n, s, offset in rows:
        assert n > 0
        by_sequence.setdefault(s, []).append((offset, n))
        by_example.setdefault(e, []).append((start, n))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= limits[0] and len(pieces) <= limits[1]
    for pieces in by_example.values():
        at = 0
        for start, n in sorted(pieces):
            assert start == at
            at += n
    return by_sequence, {e: sum(n for _, n in p) for e, p in by_example.items()}


@pytest.mark.parametrize("limits", [(64, 4, 64), (128, 8, 50), (32, 32, 32), (16, 1, 16)])
def test_packer(limits):
    rng = random.Random(limits[0])
    size = np.array([rng.choice([1, 2, 5, 30, 100, 700]) for _ in range(900)])
    prompt = np.array([rng.randrange(n) for n in size])
    p = packing.Packer(*limits)
    for a in range(0, 900, 200):
        p.add(np.arange(a, min(900, a + 200)), size[a : a + 200], prompt[a : a + 200].copy())
        p.fill(64)
    p.finish()
    rows = p.taken()
    sequences, sizes = check_packing(rows, limits)
    assert sizes == dict(enumerate(size.tolist()))
    bearing = {}
    for e, start, n, s, _ in rows:
        bearing[s] = bearing.get(s, 0) + max(0, start + n - max(start, int(prompt[e])))
    assert max(bearing.values()) <= limits[2]
    used = [sum(n for _, n in x) for x in sequences.values()]
    assert all(u == limits[0] or u & (u - 1) == 0 for u in used)


@pytest.mark.parametrize("size", [1, 3, 5, 17, 20])
def test_sequences_of_very_short_examples_need_no_padding(size):
    p = packing.Packer(2048, 64, 1984)
    for a in range(0, 6000, 1000):
        p.add(np.arange(a, a + 1000), np.full(1000, size), np.ones(1000, np.int64))
        p.fill(256)
    p.finish()
    sequences, sizes = check_packing(p.taken(), (2048, 64))
    assert sizes == dict.fromkeys(range(6000), size)
    used = [sum(n for _, n in x) for x in sequences.values()]
    assert all(u == 2048 or u & (u - 1) == 0 for u in used) and np.mean(used) >= min(2048, 32 * size)


def test_the_loss_limit_decides():
    """Eight long examples without prompts and eight of prompts alone: each full sequence needs both."""
    p = packing.Packer(64, 8, 48)
    p.add(np.arange(16), np.array([48] * 8 + [16] * 8), np.array([0] * 8 + [16] * 8))
    p.fill(0)
    sequences, _ = check_packing(p.taken(), (64, 8))
    assert [sorted(n for _, n in x) for x in sequences.values()] == [[16, 48]] * 8
    p.add(np.arange(3), np.full(3, 64), np.zeros(3, np.int64))
    p.finish()
    assert all(sum(n for _, n in x) <= 32 for x in check_packing(p.taken(), (64, 8))[0].values())


def test_prompts_are_first_lines():
    import pyarrow as pa

    from orebody.llm.common import utf8

    texts = ["", "one line", "head\nbody", " \n\nhead here\n\n body\nmore", "head\n \n", "ä\nb", "\n", "x\ny"]
    assert packing.prompts(*utf8(pa.array(texts))).tolist() == [0, 0, 5, 13, 0, 3, 0, 2]


def test_pack_documents(spark, edge, empty, edge_rows, library):
    got = packing.pack_documents(edge, BPE, end_id=1, tokens=256, segments=16, loss=240, with_ids=True).collect()
    ids = sorted(((r[0] is None, r[0] or 0), library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in edge_rows)
    total = {}
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        total.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], r["ids"]))
    for (none, i), want in ids:
        pieces = total[(None if none else i, len(want))]
        held = {s: x for s, x in pieces}
        for s, x in held.items():
            assert s + len(x) <= len(want)
        if sum(a == (none, i) for a, _ in ids) == 1:
            assert [t for _, x in sorted(pieces) for t in x] == want
    assert sum(r["length"] for r in got) == sum(len(x) for _, x in ids)
    used, bearing = {}, {}
    for r in got:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
        bearing[r["sequence_id"]] = bearing.get(r["sequence_id"], 0) + r["loss"]
    assert max(bearing.values()) <= 240 and all(n == 256 or n & (n - 1) == 0 for n in used.values())
    assert max(used.values()) <= 256 and sum(256 - u for u in used.values() if u & (u - 1)) <= 0.02 * sum(used.values())
    assert packing.pack_documents(empty, BPE).collect() == []


def test_pack_examples(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([3, 50, 400]), 2) for i in range(300)] + [(900, None, None), (901, 5, 0), (902, -4, 1)]
    df = spark.createDataFrame(rows, "example_id long, n_tokens long, n_loss long").repartition(3)
    got = [(r["example_id"], r["start"], r["length"], r["sequence_id"], r["offset"]) for r in packing.pack_examples(df, 128, 10, 20).collect()]
    _, sizes = check_packing(got, (128, 10))
    assert sizes == {i: n for i, n, _ in rows if n and n > 0}
    assert packing.pack_examples(df.limit(0)).collect() == []


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_transducer_is_the_library(pieces):
    rng = random.Random(3)
    odd = ["", " ", "a", "  a  b ", "\ta\nb", "<s>hi</s>", " " * 50, "▁x", "\x00a", "日本語😀", "a" * 1500, "the " * 400, "ab" * 900] + ["w" + " " * k + "zq" for k in range(70)]
    odd += ["".join(rng.choice("abcdethinso  ▁\n.,ABÉé1日\x07😀") for _ in range(rng.randrange(60))) for _ in range(3000)]
    assert transducer.Transducer(PIECES)(odd).tolist() == [len(x) for x in pieces.encode(odd)]


def test_chunk_maps_compose(pieces, monkeypatch):
    texts = ["unbrokenruns" * 30, "some words and then averyverylongwordwithoutanyspace" * 5 + " end", "x y z " * 40, "日" * 90 + " a"]
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(transducer, "CHUNK", size)
        assert transducer.Transducer(PIECES)(texts).tolist() == [len(x) for x in pieces.encode(texts)]


def test_blocks_of_long_texts(pieces, monkeypatch):
    monkeypatch.setattr(transducer, "CHUNK", 16)
    monkeypatch.setattr(transducer, "BLOCK", 100)
    monkeypatch.setattr(transducer, "KEPT", 60)
    rng = random.Random(6)
    texts = ["aaaa" * 200, "".join(rng.choice("abcdeé ") for _ in range(3000)), "unbroken" * 90, " " * 400, "ab" * 49, "日" * 333, "x", ""]
    assert transducer.Transducer(PIECES)(texts).tolist() == [len(x) for x in pieces.encode(texts)]


def test_neighbours_against_merging():
    """Two tokens may follow each other if merging their joined text, step by step, gives these two."""
    own, rng = transducer.Transducer(PIECES), random.Random(9)
    names = [x for x in own.score if x.strip("▁") and own._fits(None, x)]
    close = [x for x in names if x.isascii() and 2 <= len(x) <= 5]
    for _ in range(4000):
        a, b = rng.choice(close if rng.random() < 0.7 else names), rng.choice(close).lstrip("▁")
        if b in own.score and own._fits(None, b):
            assert own._fits(a, b) == (own._merged(a + b)[0] == [a, b])
    assert own._fits("a", "a") == (own._merged("aa")[0] == ["a", "a"])


def test_too_many_characters_are_refused(monkeypatch):
    monkeypatch.setattr(transducer, "CLASSES", 6)
    with pytest.raises(ValueError):
        transducer.Transducer(PIECES)


def test_kept_transitions_begin_anew(pieces, monkeypatch):
    monkeypatch.setattr(transducer, "KEPT", 40)
    own, rng = transducer.Transducer(PIECES), random.Random(5)
    for _ in range(4):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(5)) for _ in range(50)) for _ in range(3)]
        assert own(texts).tolist() == [len(x) for x in pieces.encode(texts)]


def test_token_counts(edge, empty, edge_rows, pieces):
    got = sorted((tuple(r) for r in transducer.token_counts(edge, PIECES, 100).collect()), key=key)
    want = [(r[0], len((r[1] or "").encode()), len(pieces.encode(r[1] or ""))) for r in edge_rows]
    assert got == sorted(((*w, w[2] > 100) for w in want), key=key)
    assert transducer.token_counts(empty, PIECES).collect() == []


def test_corpus_counts(corpus, pieces):
    docs, _ = corpus
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(r["n_tokens"] == len(pieces.encode(texts[r["doc_id"]])) for r in transducer.token_counts(docs, PIECES).collect())
