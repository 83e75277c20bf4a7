"""Each operator against brute force, on small tables with nulls, empty and odd texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import time
import tracemalloc
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from glyphframe.llm import bpe, fingerprints, langid, linededup, media, packing, quality, simhash, suffixes, toxicity  # noqa: E402
from glyphframe.llm.features import with_meta  # noqa: E402
from glyphframe.llm.common import Scatter, keyed, shingle_hashes, unpack, word_hashes  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, line string, bucket int, kind string"


def prose(rng, words):
    return " ".join("".join(rng.choice(["ka", "to", "mi", "re", "lo", "un"]) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [prose(rng, n) for n in (1, 3, 4, 5, 40, 120, 300, 3000)]
    near = base[5].replace("ka", "xa", 1)
    lines = "\n".join([base[4], "", "  " + base[4], base[4] + "x", base[2], prose(rng, 30)])
    texts = [*base, near, base[6], None, "", " \n\t", "日本語 テキスト 한국어 é ÀÉ <|endoftext|> 'S", "a" * 3000, lines, lines, base[5][:100] + base[6][200:900] + "\x00é", "idiot " * 9]
    return [(i * 7 % 50, t) for i, t in enumerate(texts)] + [(7, base[1]), (7, base[1]), (7, "other words of the same id " * 4), (None, base[6]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "en", "s", None if t is None else len(t), "f", "l", 1, "k") for d, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_scatter_round_trip():
    s = Scatter(0, 4, ["<u8", "<u4", "V3"])
    a, b = np.arange(10, dtype=np.uint64) << 40, np.arange(10, dtype=np.uint32)
    c = np.frombuffer(bytes(range(30)), "V3")
    s.add((a % 4).astype(np.int32), a, b, c)
    (batch,) = s.flush()
    got = unpack(list(zip(batch.column("n").to_pylist(), batch.column("blob").to_pylist())), s.dtypes)
    assert sorted(zip(*(x.tolist() for x in got))) == sorted(zip(a.tolist(), b.tolist(), c.tolist()))


def test_word_and_shingle_hashes():
    w = word_hashes(b"a b  a\nbb")[0]
    assert w[0] == w[2] and len(set(w.tolist())) == 3
    assert len(shingle_hashes(w, 5)) == 1 and len(shingle_hashes(w, 2)) == 3 and len(shingle_hashes(w[:0], 5)) == 1


def test_fingerprints(docs, rows, empty):
    got = fingerprints.compare_with_next(keyed(docs)).collect()
    assert len(got) == len(rows)
    order = sorted(((d if d is not None else -(1 << 63), t or "") for d, t in rows), key=lambda r: (-r[0], r[1]))
    want = []
    for (_, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        want.append((len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    assert sorted((r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    by_text = {}
    for r in fingerprints.fingerprint(docs).collect():
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(by_text[0]) == 1
    rng = random.Random(1)
    words = prose(rng, 4000).split()
    for share in (0.0, 0.5, 0.8, 1.0):
        k = int(len(words) * 2 * share / (1 + share)) // 2
        a, b = " ".join(words[:2000]), " ".join(words[2000 - k : 4000 - k])
        sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a.split(), b.split())]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        assert abs(fingerprints.likeness(fingerprints.bins_of(a), fingerprints.bins_of(b)) - true) < 0.1
    values = fingerprints.bins_of("x y")
    assert (fingerprints.unpack(fingerprints.pack(values)) == values).all()
    assert fingerprints.compare_with_next(keyed(empty)).count() == 0


def test_packing(docs, rows, empty):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted(tuple(tok.encode(t or "", add_special_tokens=False).ids + [0]) for _, t in rows)
    got = [r.asDict() for r in packing.pack(docs).collect()]
    assert sum(p["length"] for p in got) == sum(map(len, want))
    crcs = {zlib.crc32(np.array(ids[p["start"] : p["start"] + p["length"]], "<u4").tobytes()) for p in got for ids in want if len(ids) == p["doc_tokens"]}
    assert all(p["ids_crc32"] in crcs for p in got)
    seqs = {}
    for p in got:
        seqs.setdefault(p["sequence_id"], []).append((p["offset"], p["length"], p["sequence_tokens"]))
    for s in seqs.values():
        at = 0
        for off, n, _ in sorted(s):
            assert off == at
            at += n
        assert at == s[0][2] <= 1024 and (at == 1024 or at & (at - 1) == 0)
    assert packing.pack(empty).count() == 0
    pieces, caps = packing.assign([5, 700, 600, 1, 1023])
    assert sum(caps) == 5 + 700 + 600 + 1 + 1023 and all(sum(x[1] for x in p) == n for p, n in zip(pieces, [5, 700, 600, 1, 1023]))


def test_language(spark, docs, empty):
    rng = random.Random(2)
    make = {"aa": ["ka", "to", "mi"], "bb": ["zu", "pe", "xo"]}
    data = [(i, " ".join("".join(rng.choice(make[k]) for _ in range(3)) for _ in range(30)), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "katomi", None), (None, "katomi", "bb")]
    train = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model[0] == ["aa", "bb"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(train, model).collect()}
    assert all(got[i][0] == k for i, _, k in data[:80]) and got[900] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.where("text RLIKE '\\\\p{L}'").count()
    assert langid.fit(train.limit(0))[0] == [] and langid.predict(train, ([], np.zeros((0, langid.DIM)))).where("lang_pred <> 'und'").count() == 0
    assert langid.keep_known(empty, model).count() == 0


def near(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or max(len(a), len(b)) < 5:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_lines(rows):
    """By doc_id, with no id shared by different texts: the kept text of each."""
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        parts = []
        for x in t.split("\n"):
            s = x.strip()
            gone = bool(s) and any(near(s, y) for y in seen)
            if s:
                seen.append(s)  # a line that goes still counts as an earlier one
            if not gone:
                parts.append(x)
        out[d] = "\n".join(parts) if any(p.strip() for p in parts) or len(parts) == len(t.split("\n")) else ""
    return out


def test_line_dedup(spark, docs, rows, empty):
    rng = random.Random(3)
    pool = [prose(rng, rng.randint(1, 12)) for _ in range(40)] + ["ab", "abc", "abcd", "abcde", "éééé", "éééée", "x"]

    def edited(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice([s[:i] + "é" + s[i:], s[:i] + s[i + 1 :], s[:i] + "q" + s[i + 1 :], s])

    data = [(i, "\n".join(edited(rng.choice(pool)) for _ in range(rng.randint(1, 6)))) for i in range(120)]
    got = {r.doc_id: r.text for r in linededup.dedup(frame(spark, data)).collect()}
    want = brute_lines(data)
    assert {d: t for d, t in got.items() if t != want[d]} == {}
    out = linededup.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("text IS NULL").count() == 2 and out.where("n_chars <> length(text)").count() == 0
    assert linededup.dedup(empty).count() == 0


def test_classifiers(spark, empty):
    rng = random.Random(4)
    data = [(i, prose(rng, 30) + (" vile" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(240)] + [(500, None, None), (501, "", None), (None, "x", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, y int")
    labels = df.select("doc_id", F.col("y").alias("toxic"), (1 - F.col("y")).alias("quality"))
    for op, label, threshold in ((toxicity, "toxic", 0.5), (quality, "quality", 0.3)):
        model = op.fit(with_meta(df), labels, label)
        got = {r.doc_id: r for r in op.score_rows(with_meta(df), model.score, threshold).collect()}
        scores = np.array([got[i].score for i in range(240)])
        y = np.array([i % 3 == 0 for i in range(240)]) ^ (label == "quality")
        assert scores[y].mean() > scores[~y].mean() + 0.2 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got.values())
        assert got[5].held_out == (zlib.crc32(b"5") % 5 == 0)
        blank = op.fit(with_meta(df), labels.limit(0), label)
        assert blank.score("any", []) == pytest.approx(0.5, abs=0.02)
        assert op.score_rows(with_meta(empty), model.score, threshold).count() == 0


def test_machine_pairs_in_linear_time():
    m = quality.Machine([])
    i, x = np.array([1, 5, 9]), np.array([0.5, -1.0, 2.0])
    m.v = np.random.default_rng(1).normal(size=m.v.shape)
    want = m.w0 + m.w[i] @ x + sum(float(m.v[i[a]] @ m.v[i[b]]) * x[a] * x[b] for a in range(3) for b in range(a))
    assert m.raw(i, x)[0] == pytest.approx(want)


def test_bpe(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.Bpe(path)
    for _, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t or "") == ids and own.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = sorted((r.n_tokens, r.ids_sha256) for r in bpe.digests(docs).collect())
    assert got == sorted((len(i := tok.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for _, t in rows)
    assert {len(r.ids) for r in bpe.encode(docs).collect()} == {n for n, _ in got} and bpe.encode(empty).count() == 0


class Unseekable:
    def __init__(self, file):
        self.file = file

    def write(self, data):
        return self.file.write(data)

    def flush(self):
        pass


def test_media(spark, docs, empty):
    import gzip
    import io
    import wave
    import zipfile

    png = media.png_of(media.payload_of("text"))
    assert media.samples_of(png).tobytes() == media.payload_of("text")
    wav, zipped = io.BytesIO(), io.BytesIO()
    with wave.open(wav, "wb") as w:
        w.setnchannels(1), w.setsampwidth(1), w.setframerate(8000), w.writeframes(bytes(100))
    with zipfile.ZipFile(zipped, "w") as z:
        z.writestr("a", b"BM, GIF89a")
    gif = b"GIF89a" + bytes([1, 0, 1, 0, 0x80, 0, 0]) + bytes(6) + b"," + bytes([0, 0, 0, 0, 1, 0, 1, 0, 0, 2, 2, 0x44, 1, 0]) + b";"
    bmp = b"BM" + (54 + 4).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (1).to_bytes(4, "little") * 2 + b"\1\0\x18\0" + bytes(24) + bytes(4)
    jpeg = b"\xff\xd8\xff\xe0\0\4ab\xff\xda\0\4abxx\xff\0x\xff\xd9"
    pdf = b"%PDF-1.4 x startxref 0 %%EOF"
    known = {"image/png": png, "audio/wav": wav.getvalue(), "application/zip": zipped.getvalue(), "image/gif": gif, "image/bmp": bmp, "image/jpeg": jpeg, "application/pdf": pdf, "application/gzip": gzip.compress(b"x")}
    for kind, data in known.items():
        assert media.sniff(data) == (kind, len(data), []), kind
        assert media.sniff(data[:-1])[0] != kind or kind == "application/pdf"
        assert media.sniff(b"junk" + data + png)[2] == [(4, len(data), kind), (4 + len(data), len(png), "image/png")]
    streamed = io.BytesIO()
    with zipfile.ZipFile(Unseekable(streamed), "w") as z:  # sizes stand behind the data
        z.writestr("a", b"x" * 100)
        z.writestr("b", b"PK")
    box = lambda kind, body: (8 + len(body)).to_bytes(4, "big") + kind + body
    mp4 = box(b"ftyp", b"isom\0\0\0\0") + box(b"moov", bytes(9)) + box(b"mdat", b"BM" * 9)
    page = lambda flags, body: b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body
    ogg = page(2, b"head") + page(0, b"more") + page(4, b"end")
    mp3 = b"ID3\4\0\0\0\0\0\2xx" + (b"\xff\xfb\x90\0" + bytes(413)) * 3
    tiff = b"II*\0" + (8).to_bytes(4, "little") + (2).to_bytes(2, "little") + b"".join(t.to_bytes(2, "little") + (4).to_bytes(2, "little") + (1).to_bytes(4, "little") + v.to_bytes(4, "little") for t, v in ((273, 38), (279, 6))) + bytes(4) + b"pixels"
    body = b"%PDF-1.4\n1 0 obj x endobj\n"
    old = body + b"xref\n0 1\nstartxref\n" + str(len(body)).encode() + b"\n%%EOF"
    saved = old + b"\n2 0 obj y endobj\n"
    saved += b"xref\n0 2\nstartxref\n" + str(len(saved)).encode() + b"\n%%EOF"
    for kind, data in {"application/zip": streamed.getvalue(), "video/mp4": mp4, "application/ogg": ogg, "audio/mpeg": mp3, "image/tiff": tiff, "application/pdf": saved}.items():
        assert media.sniff(data) == (kind, len(data), []), kind
        assert media.sniff(b"junk" + data + png)[2] == [(4, len(data), kind), (4 + len(data), len(png), "image/png")], kind
    assert media.found(old + saved) == [(0, len(old), "application/pdf"), (len(old), len(saved), "application/pdf")]
    flac = b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8" + bytes(20)
    assert media.sniff(flac) == ("audio/flac", len(flac), []) and media.sniff(flac[:-22])[0] == media.UNKNOWN
    many = b"%PDF-1" * 200_000 + b"startxref 5 %%EOF" + b"%%EOF" * 100_000 + b"PK\3\4PK\5\6" * 100_000 + b"ID3" * 100_000
    began = time.perf_counter()
    media.found(many)
    assert time.perf_counter() - began < 20
    df = spark.createDataFrame([(1, png, "image/gif"), (2, None, "x"), (3, bytearray(), None), (4, b"RIFF....", "audio/wav")], "id long, media binary, declared string")
    got = {r.id: (r.media_type, r.corrected) for r in media.sniff_columns(df, "id", "media", "declared").collect()}
    assert got == {1: ("image/png", True), 2: (None, False), 3: (media.UNKNOWN, True), 4: (media.UNKNOWN, True)}
    assert media.sniff_columns(media.stored(docs), "doc_id", "media", "declared").where("media_type <> 'image/png'").count() == 0
    assert media.stored(empty).count() == 0


def brute_components(fps, radius):
    out = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    return out


def test_simhash_links(spark):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(6)]
    fps = {0, 1, (1 << 64) - 1}
    for c in centres:
        fps |= {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 7))) for _ in range(60)}
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(signed)], "doc_id long, fp long")
    got = {r.fp: r.component_id for r in simhash.classes(rows).collect()}
    assert [got[f] for f in signed] == brute_components(fps, 4)
    a, b = simhash.spanning(*(np.array(x, np.uint64) for x in zip(*[(fps[i], fps[j]) for i in range(60) for j in range(i)])))
    assert len(a) == 59


def test_crowded_keys(spark, monkeypatch):
    rng = random.Random(7)
    centre = rng.getrandbits(63)
    fps = sorted({centre ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(150)})
    rows = spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")
    monkeypatch.setattr(simhash, "BLOCK", 8)
    got = {r.fp: r.component_id for r in simhash.classes(rows).collect()}
    assert [got[f] for f in fps] == brute_components(fps, 4)


def test_thresholds():
    cost, ts = simhash.allocate([[0, 1, 5, 9, 99, 999], [0, 2, 3, 9, 99, 999], [0, 1, 9, 9, 99, 999]], 4)
    assert sum(t + 1 for t in ts) == 5 and cost == min(cost, 1 + 3 + 9 + 0)


def test_near_copies(spark, docs, rows, empty):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert len(texts) == len(set(texts)) and sum(t in (None, "", " \n\t") for t in texts) == 1
    # the near-copy of the 120-word text goes, other texts stay
    long_texts = {t for _, t in rows if t and len(t.split()) >= 100}
    assert len([t for t in texts if t in long_texts]) == len(long_texts) - 1
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(keyed(empty)).count() == 0


@pytest.mark.parametrize("block", [4096, 16])
def test_near_copies_of_graded_edits(spark, monkeypatch, block):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    texts = [[rng.choice(words) for _ in range(200)]]
    for _ in range(150):
        text = list(texts[0] if rng.random() < 0.5 else rng.choice(texts))
        for at in rng.sample(range(200), rng.randint(2, 5)):
            text[at] = rng.choice(words)
        texts.append(text)
    texts = [" ".join(t) for t in texts]
    fps, bins = [simhash.simhash(t, simhash.NEAR_WORDS, True) for t in texts], [fingerprints.bins_of(t) for t in texts]
    out = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if fps[i] == fps[j] or (fps[i] ^ fps[j]).bit_count() <= simhash.NEAR_RADIUS and fingerprints.likeness(bins[i], bins[j]) >= simhash.SIMILARITY - simhash.MARGIN:
                a, b = out[i], out[j]
                out = [min(a, b) if x in (a, b) else x for x in out]
    monkeypatch.setattr(simhash, "BLOCK", block)
    kept = simhash.keep_one(frame(spark, enumerate(texts)))
    assert 1 < len(set(out)) and {r.doc_id for r in kept.collect()} == set(out)


def brute_spans(rows, length=suffixes.LENGTH):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            if d is not None:
                first[b[i : i + length]] = min(first.get(b[i : i + length], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("crowd", [(suffixes.CROWD, suffixes.LOCAL), (1, 1), (1, 1 << 30)])
def test_suffix_dedup(spark, docs, rows, empty, crowd, monkeypatch):
    monkeypatch.setattr(suffixes, "CROWD", crowd[0])
    monkeypatch.setattr(suffixes, "LOCAL", crowd[1])
    rng = random.Random(8)
    passages = [prose(rng, 20) for _ in range(6)] + ["-" * 200, "ab" * 90]
    more = [(100 + i, " ".join(rng.choice(passages)[rng.randint(0, 30) :] + prose(rng, rng.randint(0, 6)) for _ in range(4))) for i in range(60)]
    # one id's texts are told apart: only the copy of an earlier document's goes
    same_id = [(1, passages[0]), *((2, passages[0] + f" {i}" + prose(rng, 30)) for i in range(2)), *((2, prose(rng, 25)) for _ in range(300))]
    for data in (rows, more, same_id):
        got = [tuple(r) for r in suffixes.digests(frame(spark, data)).collect()]
        assert sorted(got, key=str) == brute_spans(data)
    out = suffixes.dedup(docs)
    assert out.columns == docs.columns and out.count() == len(rows) and out.where("n_chars <> length(text)").count() == 0
    assert suffixes.dedup(empty).count() == 0


def test_suffix_dedup_in_portions(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PORTION", 3)
    rng = random.Random(9)
    passages = [prose(rng, 20) for _ in range(6)]
    data = [(i, " ".join(rng.choice(passages)[rng.randint(0, 30) :] + prose(rng, rng.randint(0, 6)) for _ in range(4))) for i in range(40)]
    assert sorted((tuple(r) for r in suffixes.digests(frame(spark, data)).collect()), key=str) == brute_spans(data)
    anchor = np.array([5, 1, 5, 2, 1, 5, 9, 5, 3])
    assert [anchor[p].tolist() for p in suffixes.portions(anchor, 3)] == [[1, 1, 2], [3, 5, 5, 5, 5], [9]]


def test_suffix_bucket_memory(spark):
    """A bucket's strings are held once; what its index takes beside them does not grow with them."""

    class Dealt:
        def repartitionById(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    n, rng = 400_000, np.random.default_rng(3)
    out = Scatter(suffixes.SEGMENTS, 1, suffixes.STRING, 1 << 30, None, True)
    rows = np.zeros((n, suffixes.WIDEST), np.uint8)
    rows[:, :67] = rng.integers(97, 123, (n, 67))
    rows[1::2] = rows[::2]  # the odd documents repeat the even ones
    for i in range(0, n, 50_000):
        part = np.arange(i, i + 50_000)
        out.add(np.zeros(len(part), np.int32), part // 4, part, np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), np.full(len(part), 18), rows[part].view(f"V{suffixes.WIDEST}")[:, 0])
    batches = list(out.flush())
    task = suffixes.meet(Dealt(), 1, suffixes.SEGMENTS, True)
    tracemalloc.start()
    try:
        found = [r for b in task.run(iter(batches)) for r in b.to_pylist()]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    cols = unpack([(r["n"], r["blob"]) for r in found], suffixes.MARK)
    assert sorted(cols[0].tolist()) == list(range(1, n, 2)) and (cols[3] == 67).all()
    # decompressed, and once more while a blob is opened; 96 MB for a portion and the index of a shard
    size = n * sum(np.dtype(d).itemsize for d in suffixes.STRING)
    assert peak < 2 * size + (96 << 20)


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_run_length_index_streams_matches(letters):
    rng = random.Random(9)
    strings = list({"".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(80)})
    strings += [s[5:] for s in strings if len(s) > 30]  # matches that end with a string
    strings = list(dict.fromkeys(strings))
    rows = np.zeros((len(strings), 40), np.uint8)
    for r, s in zip(rows, strings):
        r[: len(s)] = np.frombuffer(s.encode(), np.uint8)
    doc = np.array([rng.randint(0, 30) for _ in strings])
    index = suffixes.RunLengthIndex(rows, np.array([len(s) for s in strings]), doc, 6)
    least = index.stream()
    for k, s in enumerate(strings):
        for i in range(len(s) - 5):
            assert least[k, i] == min(doc[j] for j, t in enumerate(strings) if s[i : i + 6] in t)
    assert len(index.lo) < sum(max(len(s) - 5, 0) for s in strings) / 2


def test_buckets_as_spark_hashes(spark):
    ids = [0, 1, -1, 1 << 40, -(1 << 63), (1 << 63) - 1]
    want = [r[0] for r in spark.createDataFrame([(i, 7 - i % 5) for i in ids], "x long, y long").select(F.pmod(F.xxhash64("x", "y"), F.lit(37)).cast("int")).collect()]
    assert suffixes.bucket_of(np.array(ids, np.int64), np.array([7 - i % 5 for i in ids]), 37).tolist() == want
