"""Each operator against brute force, on tables with nulls, empty and long texts, copies and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from attestra.llm import bpe, chat, decontam, langid, lm, media, minhash, quality, rollup, substring

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 7))) for _ in range(400)]
BENCH = " ".join(WORDS[i * 7 % 400] for i in range(14))


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    shared = prose(70, 1)
    near = prose(300, 2)
    edited = near.split()
    edited[150] = "changed"
    out = [prose(120, 10 + i) for i in range(8)]
    out += [near, " ".join(edited), near, near.upper()]
    out += [prose(40, 30 + i) + " " + shared + " " + prose(30, 60 + i) for i in range(12)]
    out += [prose(30, 90) + ", " + BENCH.upper().replace(" ", " -- ") + "! " + prose(5, 91), " ".join(BENCH.split()[:9]), "tiny one"]
    out += [None, "", "   \n\t", "!!! ??? ...", "a b c", "a b c", "Été Σ ΣΑΣ <|endoftext|> don't 中文 😀", prose(5000, 99), "x" * 3000]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 2}", len(t or "")) for i, t in enumerate(out)]
    return [*rows, (len(rows), prose(80, 5), None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def letters_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


# 1


def weighted_classes(texts):
    """Classes of {doc_id: text} by all pairs: equal texts, or weighted Jaccard of five-word shingles of 0.8 or more."""
    bags = {}
    for i, t in texts.items():
        w = letters_of(t)
        bags[i] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
    common_ = Counter(x for i, b in bags.items() for x in b)
    every = sum(common_.values())
    idf = {x: math.log(1 + every / max(n - 1, 1)) for x, n in common_.items()}
    weigh = {i: {x: n * idf[x] for x, n in b.items()} for i, b in bags.items()}
    root = {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and texts[a] and texts[b]:
                met = sum(min(v, weigh[b][x]) for x, v in weigh[a].items() if x in weigh[b])
                every_ = sum(weigh[a].values()) + sum(weigh[b].values()) - met
                if texts[a] == texts[b] or every_ and met / every_ >= 0.8:
                    x, y = sorted((root[a], root[b]))
                    root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_minhash_against_all_pairs(docs, rows):
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(docs).collect()}
    assert got == weighted_classes({r[0]: r[1] for r in rows})


def test_minhash_large_groups(spark):
    base = prose(200, 3).split()
    out = []
    for i in range(90):
        w = list(base)
        w[i * 2] = f"edit{i}"
        out.append((i, " ".join(w)))
    out += [(100 + i, prose(100, 500 + i)) for i in range(5)]
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(spark.createDataFrame(out, "doc_id long, text string"), hubs=8).collect()}
    assert {got[i] for i in range(90)} == {0} and all(got[100 + i] == 100 + i for i in range(5))


def test_minhash_family_without_original(spark):
    # Variants of a text that isn't there, most about 0.8 alike: few links go through any one of them.
    base, out = prose(400, 4).split(), []
    for i in range(120):
        w, r = list(base), random.Random(1000 + i)
        for k in range(4):
            w[r.randrange(400)] = f"v{i}x{k}"
        out.append((i, " ".join(w)))
    want = weighted_classes(dict(out))
    assert 1 < len(set(want.values())) < 120
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicate_classes(df, hubs=3).collect()}
    assert got == want


def test_sampler_estimates_weighted_jaccard():
    import numpy as np

    s = minhash.Sampler(600, 1)
    h = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)
    a, b = np.ones(40), np.concatenate([np.ones(20), np.full(20, 2.0)])
    x, y = s.draw(h[:40], a, np.array([0]))[:, 0], s.draw(h[:40], b, np.array([0]))[:, 0]
    assert abs((x == y).mean() - 40 / 60) < 0.07


# 2


def test_quality(spark, docs, rows):
    good = [(i, prose(60, 1000 + i), "en", f"h{i % 3}", 1) for i in range(150)]
    bad = [(200 + i, prose(50, 2000 + i) + " loser idiot trash " + prose(9, i), "en", "h0", 1) for i in range(60)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(200 + i, 1, 1) for i in range(45)] + [(5, None, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(good + bad + [(900, None, None, None, 0), (901, "", "en", "h9", 0)], DOCS)
    kept = {r.doc_id for r in quality.keep_good(df, labels).collect()}
    assert len(kept & set(range(120, 150))) >= 29 and not kept & {900, 901}
    assert len([i for i in range(245, 260) if i in kept]) <= 1
    assert quality.keep_good(df, labels).columns == df.columns
    none = quality.keep_good(docs, labels.where("false"))
    assert none.count() == sum(bool((r[1] or "").strip()) for r in rows)


def test_site_priors_shrink(spark):
    scored = spark.createDataFrame([("a", "a/x", 0.9)] * 400 + [("b", "b/x", 0.1)] * 400 + [("c", "c/x", 0.0)], "host string, path string, __p double")
    p = {r.path: r.site_p for r in quality.site_posteriors(scored).collect()}
    assert p["a/x"] > 0.7 and p["b/x"] < 0.3 and 0.2 < p["c/x"] < 0.5


# 3


def test_chat_roundtrip(spark):
    rows = [(1, 0, "user", "a#b\\l<"), (1, 1, "user", None), (1, 2, "assistant", "### user:\n</turn>\n"), (1, 3, "assistant", "</part>\\b"), (2, 0, None, "x"), (None, 1, "assistant:", "é😀"), (1, 2, "assistant", "zz"), (1, 2, "assistant", "zz")]
    df = spark.createDataFrame([(*r, "junk") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r.conv_id: r for r in chat.digest(chat.format_conversations(df)).collect()}
    back = {r.conv_id: r for r in chat.parse_formatted(chat.format_conversations(df)).collect()}
    for conv in (1, 2, None):
        mine = sorted((t, r or "", x or "") for c, t, r, x in rows if c == conv)
        assert [(t.role, t.text) for t in back[conv].turns] == [(r, x) for _, r, x in mine]
        text = "".join(f"{r}\n{x}\n" for _, r, x in mine)
        loss = "".join(x for _, r, x in mine if r == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.format_conversations(df.where("false")).count() == 0


# 4


def test_lm_base_exact_and_model_normal(docs, rows, empty):
    got = {r.doc_id: r for r in lm.score_documents(docs).collect()}
    counts, n = Counter(), 0
    for i, t, *_ in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            w = words_of((t or "").encode().lower().decode())
            counts.update([*w, None])
            n += len(w) + 1
    for i, t, *_ in rows:
        w = [*words_of((t or "").encode().lower().decode()), None]
        base = sum(math.log10((counts[x] + 1) / (n + len(counts) + 1)) for x in w)
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    assert lm.score_documents(empty).count() == 0


def small_model(seed=0):
    import numpy as np

    rng = np.random.default_rng(seed)
    m = lm.model_of(rng.integers(0, 3, (lm.N, lm.N)).astype(float))
    m.weights = {k: rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in m.weights.items()}
    return m


def direct_attention(m, x, i):
    """ln A of every id at place i of the ids x before, by loops over one window."""
    import numpy as np

    w, d = m.weights, lm.DIM
    start = max(0, i // lm.STRIDE * lm.STRIDE - lm.CONTEXT)
    seen = x[start : i + 1]
    s = np.array([w["qkv"][x[i], :d] @ w["qkv"][a, d : 2 * d] + w["near"][len(seen) - 1 - j] for j, a in enumerate(seen)])
    h = (np.exp(s) / np.exp(s).sum()) @ w["qkv"][seen, 2 * d :]
    z = m.direct[x[i]] + h @ w["out"]
    of_group = z - np.log(np.exp(z).sum())
    inner = np.array([m.inner[x[i], g] + h @ w["inner"][g] for g in range(lm.GROUPS)])
    inner -= np.log(np.exp(inner).sum(1, keepdims=True))
    return of_group[m.group] + inner[m.group, m.member]


def test_lm_windows_score_each_place_once():
    import numpy as np

    m, rng = small_model(), np.random.default_rng(1)
    ids = rng.integers(0, lm.N, 75).astype(np.uint16)
    texts = np.array([0, 70, 71, 75])
    last = np.roll(ids, 1)
    last[texts[:-1]] = lm.END
    got = lm.attention_ln(m, ids, last, texts)
    for a, z in zip(texts[:-1], texts[1:], strict=True):
        for i in range(z - a):
            want = direct_attention(m, last[a:z], i)
            assert np.exp(want).sum() == pytest.approx(1, rel=1e-4)
            assert got[a + i] == pytest.approx(want[ids[a + i]], abs=1e-3)


def test_lm_gradient():
    import numpy as np

    m, rng = small_model(2), np.random.default_rng(3)
    ids = rng.integers(0, 40, (6, lm.WINDOW + 1)).astype(np.uint16)
    x, y = ids[:, :-1], ids[:, 1:]

    def loss():
        h = lm.attend(m.weights, x, 0)[-1].reshape(-1, lm.DIM)
        return -float(lm.predicted_ln(m, h, x.ravel(), y.ravel()).astype(float).mean())

    g = lm.step(m, x, y)
    for k, v in m.weights.items():
        way = rng.normal(0, 1, v.shape).astype(np.float32)
        v += 2e-3 * way
        up = loss()
        v -= 4e-3 * way
        down = loss()
        v += 2e-3 * way
        assert (up - down) / 4e-3 == pytest.approx(float((g[k] * way).sum()), rel=0.05, abs=2e-3)


def test_lm_counts_and_training_take_all_documents(spark):
    import numpy as np

    path, n = lm.default_path(), 900
    df = spark.createDataFrame([(i, " ".join(WORDS[(i * 7 + k * (1 + i % 5)) % 400] for k in range(60)) + " b") for i in range(n)], "doc_id long, text string").repartition(5)
    rows, sub = lm._rows(df), lm.subwords(path)
    want, words_ = Counter(), Counter()
    for r in rows.where("NOT held_out").collect():
        ids = [lm.END, lm.END, *(int(i) for w in bytes(r.body).split() for i in sub.encoding._core_bpe.encode_single_piece(b" " + w)), lm.END]
        want.update(zip(ids, ids[1:], ids[2:], strict=False))
        words_.update(bytes(r.body).split())
    counts = lm.counted(rows, path)
    got = {r.key: r.n for r in counts.where(f"kind = {lm.TRIPLE}").collect()}
    assert got == {(a * lm.N + b) * lm.N + c: v for (a, b, c), v in want.items()}
    assert sorted(r.n for r in counts.where(f"kind = {lm.WORD}").collect()) == sorted(words_.values())
    keys = np.array(sorted(got))
    t = lm.Triples(keys, np.array([got[k] for k in keys.tolist()]))
    pair, total = keys[5] // lm.N, sum(v for k, v in got.items() if k // lm.N == keys[5] // lm.N)
    p = t.mixed(np.array([pair, pair, 3]), np.array([keys[5] % lm.N, lm.N - 1, 3]), np.full(3, 0.01))
    assert p == pytest.approx([(got[keys[5]] + 0.01 * lm.KAPPA) / (total + lm.KAPPA), (got.get(pair * lm.N + lm.N - 1, 0) + 0.01 * lm.KAPPA) / (total + lm.KAPPA), 0.01], rel=1e-4)
    # Training lowers the loss below that of the pair counts it starts from; every document gives windows.
    start = lm.model_of(lm.pair_counts(counts.where(f"kind = {lm.TRIPLE}")))
    model, windows = lm.trained(rows, start, path)
    bodies = [bytes(r.body) for r in rows.where("NOT held_out").collect()]
    assert windows >= 0.5 * len(bodies)
    b = lm.block(bodies, sub)
    mean = lambda m: float(lm.attention_ln(m, b.ids, lm.before(b), b.texts).mean())
    assert mean(model) > mean(start)


# 5


def test_media_validators_and_carving():
    import gzip
    import io
    import struct
    import zipfile

    wav = media.store_wav(b"abc")
    chunk = lambda k, x: struct.pack(">I", len(x)) + k + x + struct.pack(">I", zlib.crc32(k + x))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IDAT", b"12") + chunk(b"IEND", b"")
    gif = b"GIF89a" + bytes(7) + b"\x2c" + bytes(9) + b"\x02" + b"\x01x\x00" + b"\x3b"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", b"1")
        f.writestr("b", b"2")
    zip_, gz = z.getvalue(), gzip.compress(b"hello", mtime=0)
    for kind, x in (("audio/wav", wav), ("image/png", png), ("image/gif", gif), ("application/zip", zip_), ("application/gzip", gz)):
        assert media.sniff(x) == [(kind, 0, len(x))]
        assert media.carve(b"junk" + x + b"tail") == [(kind, x)]
        assert not media.sniff(x[:-1]) or kind == "application/zip"
    assert media.sniff(png.replace(b"12", b"13")) == []
    assert media.read_wav(media.store_wav(b"xyz")) == b"xyz"


def test_media_columns(spark):
    df = spark.createDataFrame([(1, media.store_wav(b"aa"), "image/png"), (2, b"RIFF", "x"), (3, None, "x"), (4, b"", None)], "id long, content binary, media_type string").withColumnRenamed("media_type", "said")
    got = {r.id: r for r in media.sniff_media(df, declared="said").collect()}
    assert got[1].media_type == "audio/wav" and got[1].media_type_ok is False
    assert got[2].media_type == media.UNKNOWN and got[3].media_type is None and got[4].media_items == []


def test_media_payload():
    for text in (None, "", "a", "é" * 288, "x" * 577):
        n, raw = media.payload(text)
        assert n == len((text or "").encode()) and len(raw) % 576 == 0 and len(raw) > 0 and raw[:n] == (text or "").encode() and set(raw[n:]) <= {255}


def test_media_query_against_brute_force(spark, sf):
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        raw = (r.text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))
        stored = media.store_wav(payload)
        want[r.doc_id] = (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.op5_media(spark, sf).collect()}
    assert got == want


def test_media_hits_do_not_search_to_the_end_again():
    import time

    for magic in (b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff\xda\0\x02", b"\x89PNG\r\n\x1a\n\0\x7f\0\0IHDR"):
        began = time.time()
        assert media.sniff(magic * 200_000) == []
        assert time.time() - began < 20


# 6


def test_langid(spark, empty):
    de = [(i, "der die und nicht schön " + prose(3, i), "de") for i in range(30)]
    en = [(100 + i, "the and with this that " + prose(3, i), "en") for i in range(30)]
    df = spark.createDataFrame([*de, *en, (200, None, "de"), (201, "123 !!", "en"), (202, "the with that this", None), (203, "é\0", "de")], "doc_id long, text string, lang string")
    model = langid.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model, ["doc_id"]).collect()}
    assert all(got[i][0] == "de" for i, *_ in de) and all(got[i][0] == "en" for i, *_ in en)
    assert got[200] == got[201] == ("und", 0.0) and got[202][0] == "en" and all(0 <= s <= 1 for _, s in got.values())
    none = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(df, none, ["doc_id"]).collect()} == {"und"}


def test_langid_query_against_brute_force(spark, sf):
    """Counts, log probabilities and posteriors by loops over single n-grams."""
    bucket_of = {}

    def grams(text):
        t = "".join(" " if ord(c) < 128 and not c.isalpha() else c for c in text.lower())
        for k in (2, 3):
            for j in range(len(t) - k + 1):
                g = t[j : j + k]
                if g not in bucket_of:
                    bucket_of[g] = int(langid.codes([g])[k - 2][-3 if k == 2 else -3])
                yield bucket_of[g]

    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    counts, docs = {}, Counter()
    for r in rows:
        if r.text is not None and r.lang is not None and not held(r.doc_id):
            counts.setdefault(r.lang, Counter()).update(grams(r.text))
            docs[r.lang] += 1
    langs, total = sorted(counts), {k: sum(v.values()) for k, v in counts.items()}
    got = {r.doc_id: r for r in langid.op6_langid(spark, sf).collect()}
    right = n = 0
    for r in rows:
        g = got[r.doc_id]
        assert g.held_out == held(r.doc_id)
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert g.lang_pred == "und"
            continue
        mine = Counter(grams(r.text))
        z = [math.log((docs[k] + 1) / (sum(docs.values()) + len(langs))) + sum(m * math.log((counts[k][b] + 0.5) / (total[k] + 0.5 * langid.BUCKETS)) for b, m in mine.items()) for k in langs]
        top = max(z)
        p = 1 / sum(math.exp(x - top) for x in z)
        assert (g.lang_pred, g.score) == (langs[z.index(top)], pytest.approx(p, abs=1e-3))
        if g.held_out and r.lang:
            n += 1
            right += g.lang_pred == r.lang
    assert right / n > 0.95


# 7


def brute_removed(rows, window=50):
    seen, out = {}, {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        w = words_of(t)
        for j in range(len(w) - window + 1):
            seen.setdefault(tuple(w[j : j + window]), i)
    for i, t, *_ in rows:
        w = words_of(t)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out[i] = b" ".join(x for x, g in zip(w, gone) if not g) if any(gone) else None
    return out


@pytest.mark.parametrize("few", [1, 3, 100])
def test_substring_both_ways(docs, rows, few):
    want = brute_removed(rows)
    got = {r.doc_id: r.text for r in substring.dedup_substrings(docs, few=few).collect()}
    text = {r[0]: r[1] for r in rows}
    assert got == {i: text[i] if k is None else k.decode() for i, k in want.items()}


def test_suffix_automaton():
    r = random.Random(3)
    for _ in range(50):
        a, b = [r.randrange(3) for _ in range(40)], [r.randrange(3) for _ in range(40)]
        least = 5
        cover = [False] * 40
        for i in range(40 - least + 1):
            if any(a[j : j + least] == b[i : i + least] for j in range(36)):
                cover[i : i + least] = [True] * least
        got = [False] * 40
        for x, y in substring.SuffixAutomaton(a).spans(b, least):
            got[x:y] = [True] * (y - x)
        assert got == cover


# 8


def test_bpe_equals_library(docs, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    got = {r.doc_id: r for r in bpe.encode_documents(docs.withColumn("ids", docs.doc_id)).collect()}
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert [int.from_bytes(got[i].ids[k : k + 4], "little") for k in range(0, len(got[i].ids), 4)] == ids
        assert got[i].decoded == t.decode(ids, skip_special_tokens=False) and got[i].n_tokens == len(ids)


# 9


def test_rollup_is_idempotent(spark, tmp_path):
    d = lambda *r: spark.createDataFrame(list(r), "source string, lang string, version string, docs long, tokens long")
    store = rollup.TokenRollup(spark, f"file://{tmp_path}/store")
    assert store.totals().count() == 0
    assert store.commit("1", d(("a", "en", "v", 1, 10), ("a", "en", "v", 1, 5), (None, None, "v", 1, 2)))
    assert not store.commit("1", d(("a", "en", "v", 9, 99)))
    store.commit("2", d(("a", "en", "v", 0, -3)))
    store.commit("3", d((None, None, "v", -1, -2)))
    store.commit("4", d())
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "v", 2, 12)]
    # After compaction a batch that was committed stays so; one that broke off doesn't count and can be written again.
    other = store.compact(f"file://{tmp_path}/other")
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v", 2, 12)] and other.ids() == ["1", "2", "3", "4"]
    assert not other.commit("1", d(("a", "en", "v", 9, 99))) and not other.commit("4", d(("a", "en", "v", 9, 99)))
    d(("a", "en", "v", 7, 70)).drop("docs").selectExpr("*", "7L as docs").write.parquet(f"{tmp_path}/other/batch=5")
    (tmp_path / "other" / "batch=5" / "_SUCCESS").unlink()
    assert [tuple(r) for r in other.totals().collect()] == [("a", "en", "v", 2, 12)] and not other.committed("5")
    assert other.commit("5", d(("a", "en", "v", 1, 1))) and [tuple(r) for r in other.totals().collect()] == [("a", "en", "v", 3, 13)]
    again = other.compact(f"file://{tmp_path}/third")
    assert again.ids() == ["1", "2", "3", "4", "5"] and [tuple(r) for r in again.totals().collect()] == [("a", "en", "v", 3, 13)]
    with pytest.raises(ValueError):
        store.commit("../x", d())


def test_rollup_counts_as_the_libraries_do(spark, docs, rows, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    byte.encode_special_tokens = True
    n = lambda t, x: len(t.encode(x or "", add_special_tokens=False).ids)
    got = {r.doc_id: (r[rollup.WORD], r[rollup.BYTE]) for r in rollup.token_counts(docs, ["doc_id", "lang"]).collect()}
    assert got == {i: (n(word, t), n(byte, t)) for i, t, *_ in rows}
    assert rollup.token_counts(empty, ["doc_id"]).count() == 0


def test_rollup_query_against_brute_force(spark, sf):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic == 1}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = Counter()
    for r in rollup.token_counts(docs, ["doc_id", "source", "lang"]).collect():
        if r.doc_id not in toxic:
            for v in (rollup.WORD, rollup.BYTE):
                want[r.source, r.lang, v, "docs"] += 1
                want[r.source, r.lang, v, "tokens"] += r[v]
    got = {}
    for r in rollup.op9_token_rollup(spark, sf).collect():
        got[r.source, r.lang, r.version, "docs"], got[r.source, r.lang, r.version, "tokens"] = r.docs, r.tokens
    assert got == dict(want)


# 10


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_decontamination(spark, docs, rows, broadcast_rows):
    items = [(1, BENCH), (2, " ".join(BENCH.split()[:9])), (3, None), (4, "!!"), (5, " ".join(WORDS[100:130])), (6, "tiny")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_contamination(docs, benchmark, broadcast_rows=broadcast_rows).collect()}
    windows = {}
    for item, t in items:
        w = letters_of(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(str(item))
    for i, t, *_ in rows:
        w, hit, found = letters_of(t), set(), set()
        for win, ids in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found |= ids
        places = {p for h in got[i].hits for p in range(h.start, h.start + h.n)}
        assert (got[i].n_words, places, got[i]["items"]) == (len(w), hit, sorted(found)), i
    clean = {r.doc_id for r in decontam.decontaminate(docs, benchmark, broadcast_rows=broadcast_rows).collect()}
    assert clean == {i for i in got if not got[i].hits}
    assert decontam.decontaminate(docs, benchmark.where("false")).count() == len(rows)


def test_empty_tables(empty, spark):
    assert minhash.near_duplicate_classes(empty).count() == 0
    assert substring.dedup_substrings(empty).count() == 0
    assert bpe.encode_documents(empty).count() == 0
    assert decontam.find_contamination(empty, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_repeated_rows_and_ids(spark):
    t = prose(60, 8)
    df = spark.createDataFrame([(1, t), (1, t), (1, prose(60, 9)), (2, t), (None, t)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text or "") for r in substring.dedup_substrings(df).collect())
    assert got == sorted([(1, t), (1, t), (1, prose(60, 9)), (2, ""), (-1, t)])
    assert minhash.near_duplicate_classes(df).count() == 5
    assert bpe.encode_documents(df).count() == 5


def test_columns_of_any_name_pass_through(spark, docs, rows):
    """Extra columns whose names the operators might use themselves, as text, keep their values."""
    from pyspark.sql import functions as F

    names = "__rid rid row_doc spans __spans __p __q __host __path host path site_p all_p host_p c0 c1 c7 shard lot hit_rid hit_doc met_rid found own print words at".split()
    wide = docs.select("*", *[F.concat(F.lit(f"{n}-"), "doc_id").alias(n) for n in names])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, BENCH)], "item_id long, text string")
    made = {
        "keep_good": quality.keep_good(wide, labels),
        "dedup_substrings": substring.dedup_substrings(wide),
        "decontaminate": decontam.decontaminate(wide, benchmark),
        "encode_documents": bpe.encode_documents(wide),
    }
    for name, df in made.items():
        assert df.columns[: len(wide.columns)] == wide.columns, name
        for r in df.collect():
            assert all(r[n] == f"{n}-{r.doc_id}" for n in names), name


@pytest.mark.parametrize("few", [1, 2, 8])
def test_substring_hidden_windows(spark, few):
    """Documents pieced together from overlapping pieces of each other: a window across two matches is no match,
    and must be found in later documents all the same."""
    r = random.Random(11)
    pool = [f"w{i}" for i in range(400)]
    source = [pool[r.randrange(400)] for _ in range(600)]
    rows = [(i, " ".join(source[i * 40 : i * 40 + 120])) for i in range(10)]
    for i in range(10, 60):
        parts = []
        for _ in range(r.randint(1, 4)):
            donor = rows[r.randrange(len(rows))][1].split()
            a = r.randrange(max(1, len(donor) - 60))
            parts += donor[a : a + r.randint(30, 90)]
        rows.append((i, " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_removed(rows)
    for leaders in (True, False):
        got = {x.doc_id: x.text for x in substring.dedup_substrings(df, few=few, leaders=leaders).collect()}
        assert got == {i: t if want[i] is None else want[i].decode() for i, t in rows}
