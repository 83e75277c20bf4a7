"""The registered queries over a small folder of tables, value by value against plain Python, and every operator and stage over
very long texts."""

import hashlib
import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
import xxhash

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from glyphframe.functions.kernels import decode_png  # noqa: E402
from glyphframe.llm import bpe, fingerprints, langid, linededup, media, packing, quality, simhash, suffixes, toxicity  # noqa: E402
from glyphframe.llm.common import keyed  # noqa: E402
from glyphframe.llm.features import with_meta  # noqa: E402
from glyphframe.llm.queries import QUERIES  # noqa: E402


def prose(rng, words, letters="kamitorelosun"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    kinds = {"aa": "kamitore", "bb": "zupexowi"}
    out = [[i, prose(rng, rng.randint(1, 120), kinds[k]), k, "s", 0] for i, k in enumerate(["aa", "bb"] * 45)]
    for i in range(90, 110):  # near copies and exact ones
        words = out[i - 60][1].split()
        words[len(words) // 2] = "changed"
        out.append([i, " ".join(words) if i % 2 else out[i - 60][1], "aa", "s", 0])
    for r in out[::3]:
        r[1] += " vile vile vile"
    out += [[200, None, "aa", "s", None], [201, "", None, "s", 0], [202, " \t ", "bb", "s", 3], [203, "Wort! éÀ 日本", None, None, 12]]
    return [tuple(r[:4]) + (None if r[1] is None else len(r[1]),) for r in out]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(r[0], int("vile" not in (r[1] or "")), int("vile" in (r[1] or ""))) for r in rows[:100]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def run(spark, folder, name):
    return {r.doc_id: r for r in QUERIES[name](spark, folder).collect()}


def plain_bins(text):
    """Bins kept in a dictionary, empty ones filled one at a time."""
    low = {}
    for h in fingerprints.shingle_hashes(fingerprints.word_hashes(text.lower().encode())[0], 5).tolist():
        b = h >> 55
        low[b] = min(low.get(b, h), h)
    out = []
    for e in range(512):
        if e in low:
            out.append(low[e] & 15)
        else:
            donor = min(low, key=lambda b: (int(fingerprints._RANK[e, b]), b))
            value = np.array([(low[donor] + e * 0x9E3779B97F4A7C15) % (1 << 64)], np.uint64)
            out.append(int(fingerprints.mix(value)[0]) & 15)
    return out


def test_fingerprints(spark, folder, rows):
    got = run(spark, folder, "op1_fingerprints")
    order = sorted(rows, key=lambda r: -r[0])
    near = lambda a, b: min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / 512 - 1 / 16) / (15 / 16)))
    for own, following in zip(order, order[1:] + order[:1]):
        a, b = own[1] or "", following[1] or ""
        half = len(a) // 2
        edited = a[: len(a) - half] + b[:half]
        r, bins = got[own[0]], plain_bins(a)
        assert (r.n_chars, r.edited_sha256) == (len(a), hashlib.sha256(edited.encode()).hexdigest())
        assert fingerprints.unpack(r.fingerprint).tolist() == bins and fingerprints.unpack(r.edited_fingerprint).tolist() == plain_bins(edited)
        assert r.near_edited == pytest.approx(near(bins, plain_bins(edited))) and r.near_next == pytest.approx(near(bins, plain_bins(b)))


def test_short_texts_have_fingerprints_of_their_own():
    rng = random.Random(1)
    texts = list({prose(rng, 3) for _ in range(400)})
    bins = [fingerprints.bins_of(t) for t in texts]
    assert len({fingerprints.pack(b) for b in bins}) == len(texts)
    for words in range(1, 9):
        pairs = [(fingerprints.bins_of(prose(rng, words)), fingerprints.bins_of(prose(rng, words))) for _ in range(60)]
        assert max(fingerprints.likeness(a, b) for a, b in pairs) < 0.15


def test_crowded_ids_keep_the_order(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(None if rng.random() < 0.4 else rng.choice([7, 7, 7, rng.randint(0, 99)]), prose(rng, 3)) for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(fingerprints, "buckets_for", lambda _: 16)
    sizes = fingerprints.with_next(keyed(df)).selectExpr("spark_partition_id() AS p").groupBy("p").count().collect()
    assert len(sizes) > 12 and max(r["count"] for r in sizes) < 150
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (1 << 64 if h >> 63 else 0)
    order = sorted(rows, key=lambda r: (-r[0] if r[0] is not None else 1 << 63, -signed(r[1])))
    want = Counter(hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest() for (_, a), (_, b) in zip(order, order[1:] + order[:1]))
    assert Counter(r.edited_sha256 for r in fingerprints.compare_with_next(keyed(df)).collect()) == want


def test_packing(spark, folder, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {r[0]: [*tok.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    got = QUERIES["op2_packing"](spark, folder).collect()
    for p in got:
        part = ids[p.doc_id][p.start : p.start + p.length]
        assert (len(part), len(ids[p.doc_id]), zlib.crc32(np.array(part, "<u4").tobytes())) == (p.length, p.doc_tokens, p.ids_crc32)
    for doc, own in ids.items():
        places = sorted((p.start, p.length) for p in got if p.doc_id == doc)
        assert [s for s, _ in places] == np.cumsum([0, *(n for _, n in places)]).tolist()[:-1] and sum(n for _, n in places) == len(own)
    for q in {p.sequence_id for p in got}:
        parts = sorted((p.offset, p.length) for p in got if p.sequence_id == q)
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1]
        total = sum(n for _, n in parts)
        assert total == 1024 or total & (total - 1) == 0


def test_pieces_go_to_the_cheapest_sequence_with_room():
    rng = random.Random(5)
    lengths = [rng.choice([rng.randint(1, 60), rng.randint(1, 1024), rng.randint(1025, 9000)]) for _ in range(300)]
    pieces, caps = packing.assign(lengths)
    cost = lambda n: n + n * n / 1024
    items = sorted(((b - a, i, a) for i, n in enumerate(lengths) for a, b in zip(packing.cuts_of(n), packing.cuts_of(n)[1:])), key=lambda x: (-x[0], x[1], x[2]))
    room, spent, where = list(caps), [0.0] * len(caps), {(i, s): (n, k) for i, own in enumerate(pieces) for s, n, k, _ in own}
    for left, i, start in items:
        while left:
            n, k = where[i, start]
            able = [q for q in range(len(caps)) if room[q] >= left]
            assert k == (min(able, key=lambda q: (spent[q], q)) if able else max(range(len(caps)), key=lambda q: (room[q], -q))) and n == min(left, room[k])
            room[k] -= n
            spent[k] += cost(n)
            start, left = start + n, left - n
    assert not any(room) and sum(caps) == sum(lengths)


def test_languages(spark, folder, rows):
    got = run(spark, folder, "op3_language_id")
    learned = [r for r in rows if r[2] and zlib.crc32(str(r[0]).encode()) % 4 != 2]

    def bundle(text):
        out, clean = np.zeros(langid.DIM), " " + "".join(c if c.isalpha() else " " for c in (text or "").lower()) + " "
        clean = " ".join(["", *clean.split(), ""]) if clean.strip() else ""
        for a, b, c in zip(clean, clean[1:], clean[2:]):
            v = [langid.letter_vector(0 if x == " " else ord(x)).astype(float) for x in (a, b, c)]
            out += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        return out

    unit = lambda v: v / max(np.linalg.norm(v), 1e-9)
    protos = {k: unit(sum(unit(bundle(r[1])) for r in learned if r[2] == k)) for k in ("aa", "bb")}
    mean = sum(protos.values()) / 2
    protos = {k: unit(v - mean) for k, v in protos.items()}
    for r in rows:
        own, held = unit(bundle(r[1])), zlib.crc32(str(r[0]).encode()) % 4 == 2
        cos = {k: float(own @ v) for k, v in protos.items()}
        best = max(sorted(cos), key=cos.get) if own.any() else "und"
        score = 1 / sum(math.exp(langid.SHARPNESS * (c - cos[best])) for c in cos.values()) if own.any() else 0.0
        assert (got[r[0]].lang_pred, got[r[0]].held_out) == (best, held) and got[r[0]].score == pytest.approx(score, abs=1e-4)


def test_quality(spark, folder, rows):
    got = run(spark, folder, "op5_quality")
    labels = {r[0]: int("vile" not in (r[1] or "")) for r in rows[:100] if zlib.crc32(str(r[0]).encode()) % 5}
    meta = lambda r: ["n_chars=" if r[4] is None else f"n_chars={int(math.log2(r[4] + 1))}"]
    machine = quality.Machine([(labels[r[0]], *(np.asarray(x, d) for x, d in zip(quality.features(r[1] or "", meta(r)), (np.int64, np.float32, np.float32)))) for r in sorted(rows) if r[0] in labels])
    for r in rows:
        i, x = machine.row(*quality.features(r[1] or "", meta(r)))
        v = machine.v[i].astype(float) * x[:, None]
        z = machine.w0 + float(machine.w[i] @ x) + sum(float(v[a] @ v[b]) for a in range(len(i)) for b in range(a))
        assert got[r[0]].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)
        assert (got[r[0]].predicted, got[r[0]].held_out) == (int(got[r[0]].score >= 0.3), zlib.crc32(str(r[0]).encode()) % 5 == 0)


def test_metadata_is_learned(spark):
    rng = random.Random(6)
    data = [(i, prose(rng, 20), "good.org" if i % 2 else "bad.org") for i in range(300)]
    df = spark.createDataFrame(data, "doc_id long, text string, host string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    docs = with_meta(df, ("host",))
    model = quality.fit(docs, labels)
    assert model.score("ka mi", ["host=good.org"]) > model.score("ka mi", ["host=bad.org"]) + 0.3


def test_bpe(spark, folder, rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, folder, "op6_bpe")
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[r[0]].n_tokens, got[r[0]].ids_sha256, got[r[0]].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))


def test_bpe_of_every_code_point():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, own = Tokenizer.from_file(path), bpe.Bpe(path)
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x30000 or c % 997 == 0)]
    for k in range(0, len(codes), 64):
        texts = [f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)}" for c in codes[k : k + 64]]
        assert [own.encode(t) for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts], hex(codes[k])


def test_media(spark, folder, rows):
    got = run(spark, folder, "op7_media")
    for r in rows:
        data = (r[1] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        png = media.png_of(payload)
        pixels = decode_png(png) if len(payload) > 576 else None  # a decoder of its own, which takes two rows at least
        assert pixels is None or pixels.tobytes() == payload
        x = got[r[0]]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (x.media_bytes, x.media_sha256, x.media_type) == (len(png), hashlib.sha256(png).hexdigest(), "image/png")
        flat, high = list(payload), len(payload) // 576
        means = [sum(flat[c::3]) / (len(flat) / 3) for c in range(3)]
        kind, size, depth, mean, hashed, carved = x.feature.split(";")
        assert (kind, size, depth, carved) == ("image/png", f"192x{high}", "rgb8", "carved=0") and [float(v) for v in mean[5:].split(",")] == pytest.approx(means, abs=6e-4)
        assert len(hashed) == 6 + 16


def plain_simhash(text, words, distinct=False):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    tokens = [t for t in low.translate({k: " " for k in (*range(9, 14), 32)}).split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in (set(shingles) if distinct else shingles)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, folder, rows):
    got = run(spark, folder, "op8_simhash")
    fps = {r[0]: plain_simhash(r[1], 4) for r in rows}
    root = {d: d for d in fps}
    for a in fps:
        for b in fps:
            if (fps[a] ^ fps[b]).bit_count() <= 4 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {d: low if x == high else x for d, x in root.items()}
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{fps[d]:016x}", root[d]) for d in fps}
    filler = "la " * 60
    assert simhash.simhash(filler + "one", 5, True) != simhash.simhash(filler + "some other words here", 5, True)
    assert simhash.simhash(filler + "one", 5, True) == plain_simhash(filler + "one", 5, True)


def test_near_copy_recall():
    """Of pairs by their Jaccard similarity, how many pass both the fingerprints' radius and the signatures' bound."""
    rng, found = random.Random(4), {}
    vocabulary = [f"w{i}" for i in range(5000)]
    for _ in range(1500):
        n = rng.randint(60, 300)
        a = [rng.choice(vocabulary) for _ in range(n)]
        b = list(a)
        for at in rng.sample(range(n), max(1, int(n * rng.uniform(0, 0.06)))):
            b[at] = rng.choice(vocabulary)
        sets = [{tuple(x[i : i + 5]) for i in range(n - 4)} for x in (a, b)]
        j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        if j >= 0.8:
            a, b = " ".join(a), " ".join(b)
            near = (simhash.simhash(a, 5, True) ^ simhash.simhash(b, 5, True)).bit_count() <= simhash.NEAR_RADIUS
            alike = fingerprints.likeness(fingerprints.bins_of(a), fingerprints.bins_of(b)) >= simhash.SIMILARITY - simhash.MARGIN
            found.setdefault(min(int(j * 20), 19), []).append(near and alike)
    recall = {k / 20: sum(v) / len(v) for k, v in found.items()}
    assert recall[0.8] >= 0.87 and recall[0.85] >= 0.93 and recall[0.9] >= 0.97 and recall[0.95] >= 0.99, recall


def test_toxicity(spark, folder, rows):
    got = run(spark, folder, "op10_toxicity")
    learned = [(int("vile" in (r[1] or "")), toxicity.features(r[1] or "")[0].tolist()) for r in sorted(rows[:100]) if zlib.crc32(str(r[0]).encode()) % 5]
    z, n, zb, nb = Counter(), Counter(), 0.0, 0.0
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda z, n, l1: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((b + math.sqrt(n)) / a + l2)
    for epoch in range(toxicity.EPOCHS):
        for k in np.random.default_rng([11, epoch]).permutation(len(learned)):
            y, idx = learned[k]
            w, wb = {i: weight(z[i], n[i], l1) for i in idx}, weight(zb, nb, 0.0)
            g = 1 / (1 + math.exp(-(sum(w.values()) + wb))) - y
            for i in idx:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a * w[i]
                n[i] += g * g
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / a * wb
            nb += g * g
    for r in rows:
        raw = weight(zb, nb, 0.0) + sum(weight(z[i], n[i], l1) for i in toxicity.features(r[1] or "")[0].tolist())
        assert got[r[0]].score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-4) and got[r[0]].predicted == int(got[r[0]].score >= 0.5)


def test_odd_columns(spark):
    """Columns named like the operators' own, and an n_chars that is no number, are carried along untouched."""
    schema = "doc_id long, text string, n_chars struct<a: int>, fp double, line array<int>, tag string, bucket int, __x string"
    df = spark.createDataFrame([(1, "a line that comes again and again, long enough for a passage of bytes\nb", (1,), 1.0, [1], "t", 3, "x"), (2, "a line that comes again and again, long enough for a passage of bytes\nc", (2,), 2.0, [2], "t", 3, "x")], schema)
    for op in (linededup.dedup, suffixes.dedup, simhash.keep_one):
        out = op(df)
        assert out.schema == df.schema and {r.n_chars.a for r in out.collect()} == ({1, 2} if op is not simhash.keep_one else {1})


@pytest.fixture(scope="module")
def long_rows():
    rng = random.Random(12)
    words = prose(rng, 100_000)  # one line of about 600 kB
    return [(1, " " * 1_000_000), (2, "a" * 300_000), (3, words), (4, words[:400_000] + "x" + words[400_001:]), (5, "\n".join(prose(rng, 3) for _ in range(40_000))), (6, "短" * 100_000), (7, "short"), (8, None)]


def test_very_long_texts(spark, long_rows, tmp_path):
    df = spark.createDataFrame([(d, t, "aa", "s", None if t is None else len(t)) for d, t in long_rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).cache()
    texts = {d: t or "" for d, t in long_rows}
    assert {r.doc_id: r.n_chars for r in fingerprints.compare_with_next(keyed(df)).collect()} == {d: len(t) for d, t in texts.items()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokens = {r.doc_id: (r.n, r.d) for r in packing.pack(df).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "d").collect()}
    assert all(n == d for n, d in tokens.values()) and tokens[1][0] == len(library.encode(texts[1], add_special_tokens=False).ids) + 1
    model = langid.fit(df)
    assert langid.predict(df, model).where("lang_pred = 'aa'").count() == 6 and langid.keep_known(df, model).count() == 6
    kept = {r.doc_id: r.text for r in linededup.dedup(df).collect()}
    assert kept[4] == "" and kept[3] == texts[3] and len(kept[5]) <= len(texts[5])  # the second long line is one edit from the first
    labels = spark.createDataFrame([(d, d % 2, d % 2) for d in texts], "doc_id long, toxic int, quality int")
    for op, label in ((toxicity, "toxic"), (quality, "quality")):
        docs = with_meta(df)
        assert op.score_rows(docs, op.fit(docs, labels, label).score, 0.5).where("score BETWEEN 0 AND 1").count() == 8
    assert bpe.digests(df).count() == 8 and media.stored(df).count() == 8
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(keyed(df)).collect()}[4] == 3
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == {1, 2, 3, 5, 6, 7}
    cut = {r.doc_id: r for r in suffixes.digests(df).collect()}
    assert cut[4].n_removed == len(texts[4]) - 1 + (texts[3][400_000] == "x") and cut[1].n_removed == cut[2].n_removed == 0
    df.write.parquet(f"{tmp_path}/documents.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {2, 3, 4, 5, 6, 7}  # 4 as an empty text
    df.unpersist()
