"""The ten operators against brute force, round trips and held-out rows, with nulls, ties, long and empty texts and clashing columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in enumerate(texts)], DOC)


def low(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


# 1 -----------------------------------------------------------------------------------------------
def test_caps_links_like_brute_force(spark):
    from newsloom.llm import caps

    r = np.random.default_rng(3)
    base = r.standard_normal((12, 64))
    rows = [base[i % 12] + 0.18 * r.standard_normal(64) * (i // 12 % 4) for i in range(160)]
    data = [(i, [float(np.float32(v)) for v in x], i % 2) for i, x in enumerate(rows)]
    data += [(200, None, 0), (201, [0.0] * 64, 0), (202, [1.0] * 63 + [float("nan")], 0), (203, data[0][1], None), (204, data[0][1], 0), (205, data[0][1], 0), (206, [1.0, None], 0), (207, [], 1), (208, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*d, 1) for d in data], "vec_id long, embedding array<float>, label int, n_links int").repartition(5)
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in caps.link_vectors(df).collect()}
    good = {i: np.array(v, np.float32).astype(float) for i, v, lab in data if v and lab is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    lab = {i: l for i, _, l in data}
    near = {i: [j for j in good if j != i and lab[i] == lab[j] and len(good[i]) == len(good[j]) and good[i] @ good[j] / np.linalg.norm(good[i]) / np.linalg.norm(good[j]) >= 0.93] for i in good}
    for i, _, _ in data:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i] == (len(near.get(i, [])), min(seen), i == min(seen)), i
    assert caps.link_vectors(df.where("false")).count() == 0


@pytest.mark.parametrize("dim", [3, 8, 16, 32, 64, 96, 128, 384, 768])
def test_caps_recall_at_the_threshold(dim):
    from newsloom.llm import caps

    r, n = np.random.default_rng(dim), 400 if dim < 384 else 150
    u = r.standard_normal((n, dim))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = r.standard_normal((n, dim))
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.93 * u + (1 - 0.93**2) ** 0.5 * w / np.linalg.norm(w, axis=1, keepdims=True)
    codes = caps.product_codes(dim)
    sets = []
    for x in (u, v):
        rows, ids = caps.list_decode(x, codes)
        sets.append([set(ids[rows == k].tolist()) for k in range(n)])
    assert np.mean([bool(a & b) for a, b in zip(*sets)]) >= 0.99
    assert 20 < np.mean([len(a) for a in sets[0]]) < 150


def test_caps_repeated_ids_and_wide_classes(spark, monkeypatch):
    from newsloom.llm import caps

    monkeypatch.setattr(caps, "CHUNK", 8)
    monkeypatch.setattr(caps, "MARKED", 16)
    r = np.random.default_rng(9)
    base = r.standard_normal((3, 8))
    rows = [(int(r.integers(0, 60)), [float(v) for v in base[i % 3] + 0.12 * r.standard_normal(8) * (i % 4)], i // 3 % 2) for i in range(120)]
    rows += [rows[0], rows[0], (7, rows[0][1], rows[0][2]), (None, rows[0][1], 0), (7, None, 0), (1000, None, 1)]
    got = {}
    for x in caps.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect():
        got.setdefault(x.vec_id, set()).add((x.n_links, x.component_id, x.kept))
    good = [(i, np.array(v), lab) for i, v, lab in rows if i is not None and v]
    links, near = {}, {}
    for i, v, lab in good:
        for j, w, other in good:
            if i != j and lab == other and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                links[i] = links.get(i, 0) + 1
                near.setdefault(i, set()).add(j)
    for i in {x[0] for x in rows} - {None}:
        seen, todo = {i}, [i]
        while todo:
            todo += (fresh := near.get(todo.pop(), set()) - seen)
            seen |= fresh
        assert got[i] == {(links.get(i, 0), min(seen), i == min(seen))}, i
    assert got[None] == {(0, None, False)}


def test_list_decode_finds_all_filters():
    from newsloom.llm import caps

    x = np.random.default_rng(1).standard_normal((5, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = [(t, a[:20], b[:20]) for t, a, b in caps.product_codes(16)]
    rows, ids = caps.list_decode(x, codes, 0.2)
    x = np.pad(x, ((0, 0), (0, 48)))
    want = {(k, (c * caps.WORDS + i) * caps.WORDS + j) for k in range(5) for c, (t, a, b) in enumerate(codes) for i in range(20) for j in range(20) if (x[k] @ t)[:32] @ a[i] + (x[k] @ t)[32:] @ b[j] >= 0.2}
    assert len(want) > 20
    assert set(zip(rows.tolist(), ids.tolist())) == want


# 2 -----------------------------------------------------------------------------------------------
def near_brute(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    comp = list(range(len(texts)))
    changed = True
    edges = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in edges:
            m = min(comp[i], comp[j])
            if comp[i] != m or comp[j] != m:
                comp[i] = comp[j] = m
                changed = True
    return [(i, len(s), c, c == i) for i, (s, c) in enumerate(zip(sets, comp))]


def test_near_duplicates_like_brute_force(spark):
    from newsloom.llm import chosen_path

    r = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [r.choice(vocab) for _ in range(r.choice([3, 6, 40, 120]))]
        for k in range(r.choice([1, 2, 6])):
            t = list(base)
            for _ in range(k):
                t[r.randrange(len(t))] = r.choice(vocab)
            texts.append(" ".join(t))
    hot = [r.choice(vocab) for _ in range(150)]  # a large group of copies around one text, and a passage that many share
    for _ in range(330):
        t = list(hot)
        for _ in range(r.randrange(9)):
            t[r.randrange(150)] = r.choice(vocab)
        texts.append(" ".join(t))
    texts += [" ".join(hot[:40] + [r.choice(vocab) for _ in range(60)]) for _ in range(150)]
    texts += [None, "", " \t\n", "One two", "one\ttwo", "a b c d e", "A B C D E", texts[0], texts[0], "x " * 5000]
    df = docs(spark, texts).repartition(6)
    got = sorted((x.doc_id, x.n_shingles, x.component_id, x.kept) for x in chosen_path.near_duplicates(df).collect())
    assert got == near_brute(texts)
    kept = chosen_path.keep_first(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [g[0] for g in got if g[3]]
    assert chosen_path.near_duplicates(df.where("false")).count() == 0


def test_trees_lose_few_pairs_at_every_depth():
    from newsloom.llm import chosen_path as c

    r = np.random.default_rng(8)
    equal = np.where(r.random((3000, c.COORDINATES)) < 0.75, 0, 1).astype(np.uint32)
    equal = equal[(equal == 0).sum(1) >= c.ALIKE]  # a pair is one row: where it is 0 both documents have the same value
    assert len(c.ROOTS) >= c.trees_for(c.LEVELS) >= c.trees_for(5) >= c.trees_for(1) == c.TREES
    assert all(c.lost(d, c.trees_for(d)) <= c.MISS for d in range(1, c.LEVELS + 1)) and c.lost(c.LEVELS, 12) > 100 * c.MISS
    lost = 0
    for row in equal[:400]:
        node = c.ROOTS
        for _ in range(c.LEVELS):
            r_, child = c.children(node, np.repeat(row[None], len(node), 0))
            first, other = c.chosen(node)
            at = np.concatenate([first, other[other >= 0]])
            node = child[row[at] == 0]
            node = node[:2000]
        lost += not len(node)
    assert lost == 0


def test_near_duplicates_among_shared_boilerplate(spark, monkeypatch):
    from newsloom.llm import chosen_path

    monkeypatch.setattr(chosen_path, "ROOTS", chosen_path.ROOTS[:3])  # few trees show what each of them loses
    r = random.Random(9)
    vocab, boiler, texts = [f"w{i}" for i in range(20000)], [f"b{i}" for i in range(70)], []
    for _ in range(400):
        own = [r.choice(vocab) for _ in range(50)]
        other = own[:-k] + [r.choice(vocab) for _ in range(k)] if (k := r.choice([14, 15, 16])) else own
        texts += [" ".join(boiler + own), " ".join(boiler + other)]
    texts += [" ".join(boiler + [r.choice(vocab) for _ in range(50)]) for _ in range(200)]
    got = {x.doc_id for x in chosen_path.near_duplicates(docs(spark, texts).repartition(4)).collect() if not x.kept}
    want = {g[0] for g in near_brute(texts) if not g[3]}
    assert len(want) == 400 and got <= want and len(got) > 360


def test_near_duplicates_recall_at_the_threshold_in_a_dense_cluster(spark):
    """Documents of similarity 0.6 to 0.74 around one boilerplate, and pairs planted just above the threshold."""
    from newsloom.llm import chosen_path

    r = random.Random(17)
    boiler, texts = [f"b{i}" for i in range(84)], []
    own = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    for _ in range(1500):  # 80 boilerplate shingles of 100: 0.6 to 0.74 to each other
        texts.append(" ".join(boiler + own(r.choice([16, 18, 20]))))
    planted = 0
    for _ in range(150):
        a = own(20)
        k = r.choice([9, 10])
        texts += [" ".join(boiler + a), " ".join(boiler + a[: 20 - k] + own(k))]
        planted += 1
    texts += [" ".join(own(60)) for _ in range(500)]
    got = {x.doc_id: x.component_id for x in chosen_path.near_duplicates(docs(spark, texts).repartition(4)).collect()}
    want = {i: c for i, _, c, _ in near_brute(texts)}
    missed = [i for i in want if want[i] != i and got[i] == i]
    assert all(want[i] == i or got[i] in (i, want[i]) for i in want) and all(got[i] == i for i in want if want[i] == i)
    assert sum(want[i] != i for i in want) >= planted and len(missed) <= 0.01 * planted


def test_near_duplicates_with_repeated_ids(spark):
    from newsloom.llm import chosen_path

    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (4, "other words that stand quite alone here"), (4, None), (None, a), (5, ""), (2, a + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((x.doc_id or -1, x.component_id, x.kept) for x in chosen_path.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True), (5, 5, True), (-1, None, False)], key=str)
    clash = df.withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "1 as gone", "2 as component_id", "3 as kept")
    kept = chosen_path.keep_first(clash)
    assert kept.columns == clash.columns and sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 1, 1, 4, 4, 5]


# 3 -----------------------------------------------------------------------------------------------
def contaminated_brute(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall(low(t))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    out = []
    for d, t in enumerate(texts):
        w, hit, found = word.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("blocks", [1, 3])
def test_decontamination_like_brute_force(spark, blocks, monkeypatch):
    from newsloom.llm import decontaminate

    r = random.Random(6)
    vocab = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 4, 10, 11, 25])))) for i in range(30)] + [(None, "solo"), (50, None), (51, "Ünïcode TEXT, mixed!"), (51, "again Again again again again again again again again again again")]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randrange(60))) + " " + r.choice(items)[1:][0].__str__() for _ in range(120)]
    texts += [None, "", "...", "solo", "again " * 30, "ünïcode text Mixed", "Ünïcode TEXT mixed", texts[3], "w1 " * 20000]
    bench = spark.createDataFrame(items, "item_id long, text string")
    if blocks > 1:
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 800)
    df = docs(spark, texts).repartition(3)
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = contaminated_brute(texts, items)
    assert sorted(tuple(x[c] for c in cols) for x in decontaminate.hit_report(decontaminate.match_items(df, bench)).collect()) == want
    clean = decontaminate.remove_contaminated(df.withColumnRenamed("source", "hit_spans"), bench)
    assert "hit_spans" in clean.columns and sorted(x.doc_id for x in clean.collect()) == [w[0] for w in want if not w[5]]
    assert decontaminate.match_items(df, bench.where("false")).where("size(hit_spans) > 0").count() == 0
    assert decontaminate.match_items(df.where("false"), bench).count() == 0


def longest_brute(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w, best = word.findall(low(text)), (0, -1)
    for t in items:
        v = word.findall(low(t))
        n = min(10, len(v))
        for i in range(len(w) if v else 0):
            for j in range(len(v) - n + 1):
                if w[i : i + n] == v[j : j + n]:
                    k = n
                    while i + k < len(w) and j + k < len(v) and w[i + k] == v[j + k]:
                        k += 1
                    best = max(best, (k, -i)) if best[1] != -1 or best[0] else (k, -i)
    return (best[0], -best[1]) if best[0] else (0, -1)


def test_longest_matches_like_brute_force():
    from newsloom.llm import decontaminate as d
    from newsloom.llm.common import ALNUM, word_hashes

    r = random.Random(12)
    long_item = [r.choice("abcd") for _ in range(60)]
    items = [" ".join(long_item), " ".join(long_item[5:45] + ["z"] * 20), "a b c", "q " * 40, " ".join(long_item[:30]), ""]
    texts = [" ".join(r.choice("abcd") for _ in range(20)) + " " + " ".join(long_item[k : k + n]) + " " + r.choice(["", "z z z z", "q " * 30]) for k in range(0, 45, 3) for n in (9, 12, 33)] + ["", "a b c", "q " * 25, "x"]
    test = d.prepare_items([str(i) for i in range(len(items))], pa.array(items), 10)
    got = d.match_shard(*word_hashes(pa.array(texts), ALNUM), test)
    assert list(zip(got["longest"].tolist(), got["longest_at"].tolist())) == [longest_brute(t, items) for t in texts]


def test_repeated_words_take_linear_time():
    import time

    from newsloom.llm import decontaminate as d
    from newsloom.llm.common import ALNUM, word_hashes

    texts = ["no " * 20_000, "yes no " * 10_000]
    items = ["no " * 2_000, "yes no " * 1_000, "no " * 9]
    start = time.process_time()
    test = d.prepare_items(["1", "2", "3"], pa.array(items), 10)
    got = d.match_shard(*word_hashes(pa.array(texts), ALNUM), test)
    assert time.process_time() - start < 5
    assert got["longest"].tolist() == [2000, 2000] and got["longest_at"].tolist() == [0, 0]
    assert got["start"].tolist() == [0, 0] and got["end"].tolist() == [20_000, 20_000]
    assert list(zip(got["pair_doc"].tolist(), got["pair_item"].tolist())) == [(0, 0), (0, 2), (1, 1)]


def test_suffix_array_sorts():
    from newsloom.llm.decontaminate import suffix_array

    r = np.random.default_rng(2)
    h = r.integers(0, 4, 400).astype(np.uint64)
    h[-1] = 0
    order = suffix_array(h, 64)

    def key(p):
        w = h[p : p + 64].tolist()
        return w[: w.index(0)] + [0] if 0 in w else w

    keys = [key(p) for p in order]
    assert sorted(order.tolist()) == list(range(400)) and all(a <= b for a, b in zip(keys, keys[1:]))


# 4 and 9 -----------------------------------------------------------------------------------------
TEXTS = ["", None, "a", "don't 's 'sfoo ''s  x\n\n y  ", "a<|endoftext|>b <|endoftext|>", "日本語 テスト ½ ²", " \t\n", "aaaaaaaaaa the   ", "x y z\x85q\x1c w", "😀 é é", "word " * 20000, "one  two", "one  two"]


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_like_the_library(spark):
    from newsloom.llm import bpe

    path, t = tokenizer()
    df = docs(spark, TEXTS).withColumnRenamed("source", "ids").repartition(3)
    out = bpe.digests(df, path).collect()
    back = {x.doc_id: (x.ids, x.decoded) for x in bpe.decode(bpe.encode(df, path), path).collect()}
    for x in out:
        ids = t.encode(TEXTS[x.doc_id] or "", add_special_tokens=False).ids
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert x.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert back[x.doc_id] == (ids, t.decode(ids, skip_special_tokens=False))
    assert len(out) == len(TEXTS) and bpe.encode(df.where("false"), path).count() == 0


@pytest.mark.parametrize("words", [200_000, 300])
def test_bpe_random_characters(words, monkeypatch):
    from newsloom.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_WORDS", words)
    monkeypatch.setattr(bpe, "FRESH_WORDS", words // 10)
    path, t = tokenizer()
    e, r = bpe.Encoder(bpe.Vocabulary(bpe.read_vocabulary(path))), random.Random(1)
    al = "a b'\n\t\r.,!stlredvm0129é ñ日 ​😀   -_<|>\x1c\u0107"
    texts = ["".join(r.choice(al) for _ in range(r.randrange(60))) for _ in range(3000)]
    for piece in (texts[:1000], texts[500:2500], texts[2000:], ["<|endoftext|>", "a<|endoftext|><|endoftext|>b"]):
        ids, off = e(pa.array(piece))
        assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [x.ids for x in t.encode_batch(piece, add_special_tokens=False)]
    raw = [r.randrange(50257) for _ in range(500)]
    assert bpe.decode_flat(e.v, np.array(raw), np.array([0, 500])) == [t.decode(raw, skip_special_tokens=False)]


def test_token_files_like_the_library(spark):
    from newsloom.llm import dac

    path, t = tokenizer()
    df = docs(spark, TEXTS).repartition(3)
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in dac.read_ids(dac.write_ids(df, path)).collect()}
    at = 0
    for i, text in enumerate(TEXTS):
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert got[i] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert dac.read_ids(dac.write_ids(df.where("false"), path)).count() == 0
    odd = spark.createDataFrame([(-(2**63), "a b"), (None, "c"), (5, "d e f"), (5, "d e"), (2**63 - 1, None)], "doc_id long, text string").repartition(3)
    got = sorted(((x.start, x.doc_id, x.n_tokens) for x in dac.read_ids(dac.write_ids(odd, path)).collect()))
    assert got == [(0, None, 2), (2, -(2**63), 3), (5, 5, 3), (8, 5, 4), (12, 2**63 - 1, 1)]


def test_encoders_of_two_vocabularies(spark):
    """Two vocabularies of equal length must not share an encoder."""
    import json

    from newsloom.llm import bpe, dac

    path, _ = tokenizer()
    text = bpe.read_vocabulary(path)
    model = json.loads(text)
    a, b = (t for t in list(model["model"]["vocab"]) if model["model"]["vocab"][t] in (300, 301))
    vocab = model["model"]["vocab"]
    vocab[a], vocab[b] = vocab[b], vocab[a]
    other = json.dumps(model)
    one, two = bpe.worker_encoder(text, dac.library_words), bpe.worker_encoder(other, dac.library_words)
    assert one is not two and one.v.piece_len[300] == two.v.piece_len[301] and bpe.worker_encoder(text) is not bpe.worker_encoder(text, dac.library_words)


def test_dac_access():
    from newsloom.llm import dac

    r = np.random.default_rng(0)
    for n, top in ((0, 9), (1, 9), (5000, 3), (5000, 50257), (3000, 2**31)):
        ids = r.integers(0, top, n)
        codes = dac.Codes.build(ids)
        at = r.permutation(n)
        assert (codes.access(at) == ids[at]).all()
        doc_ids, first, back, nameless = dac.open_file(dac.pack_file(np.array([7]), np.array([0, n]), ids))
        assert nameless == 0 and doc_ids.tolist() == [7] and first.tolist() == [0, n] and (back.access(np.arange(n)) == ids).all()


# 5 -----------------------------------------------------------------------------------------------
def test_licenses(spark):
    from newsloom.llm import licenses

    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    texts = [
        None, "", "Licensed under the Apache License, Version 2.0.", "licensed UNDER the apache\nlicense 2.0", "Licensed under the Apache Software License 2.0", "CC BY cc-by CC BY-NC 4.0",
        "This work is licensed under the GNU General Public License, version 3.", "This file is licensed under the terms of the GNU General Public License version 3", "All rights reserved. all rights reserved", "Copyright (c) 2020 The Big Co All Rights Reserved",
        "Released under the MIT License.", "x " * 30000 + "all rights reserved", "all rights", "cc", "by cc",
    ]
    got = {x.doc_id: x for x in licenses.scan_licenses(docs(spark, texts).withColumnRenamed("source", "labels").repartition(2)).collect()}
    for i, t in enumerate(texts):
        w = word.findall(low(t))
        places = [(k, lab) for p, lab in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word) == (len(w), len(places), min([k for k, _ in places], default=None), max([k for k, _ in places], default=None)), t
        assert x.base_labels == ",".join(sorted({lab for _, lab in places})) and 0 <= x.score <= 1 and set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(","))
    label = lambda i: got[i].labels.split(",")
    assert "apache-2.0" in label(2) and "apache-2.0" in label(3) and "apache-2.0" not in label(4) and "gpl-3.0" in label(6) and "gpl-3.0" in label(7)
    assert "copyright-notice" in label(9) and "mit" in label(10) and got[10].n_base == 0


def test_template_markup():
    from newsloom.llm.common import hash_of
    from newsloom.llm.licenses import compile_template

    a = compile_template("one <<beginOptional>>two <<beginOptional>>three<<endOptional>> <<endOptional>><<var;words=1..2>> end")
    run = lambda s: a.run(np.array([hash_of(w) for w in s.split()], np.uint64))
    assert run("one x end") == 3 and run("one two x y end more") == 5 and run("one two three x end") == 5 and run("one end") == 0 and run("one two three x y z end") == 0
    with pytest.raises(ValueError):
        compile_template("<<var;words=1..2>> end").first_words()
    with pytest.raises(ValueError):
        compile_template("a <<beginOptional>> end")


def template_regex(markup):
    """The same template as a regular expression over words that each end with a blank."""
    from newsloom.llm.licenses import words_of

    out = ""
    for part in re.split(r"(<<.*?>>)", markup, flags=re.S):
        if part == "<<beginOptional>>":
            out += "(?:"
        elif part == "<<endOptional>>":
            out += ")?"
        elif part.startswith("<<var"):
            m = re.search(r"words=(\d+)\.\.(\d+)", part)
            out += r"(?:\S+ ){%s,%s}" % (m.groups() if m else (0, 60))
        else:
            out += "".join(re.escape(w) + " " for w in words_of(part))
    return re.compile(out)


def test_templates_accept_what_their_regular_expressions_do():
    from newsloom.llm import licenses
    from newsloom.llm.common import hash_of

    r = random.Random(21)
    odd = {"nested": "one <<beginOptional>>two <<beginOptional>>three<<endOptional>> <<endOptional>><<var;words=0..2>> end", "spdx": 'start <<var;name="c";original="x; y";match=".+">> stop <<beginOptional>>now<<endOptional>>'}
    for label, markup in (licenses.TEMPLATES | odd).items():
        machine, pattern = licenses.compile_template(markup), template_regex(markup)
        parts = re.split(r"(<<.*?>>)", markup, flags=re.S)
        seen = 0
        for _ in range(60):
            words, depth, skip = [], 0, 0
            for part in parts:
                if part == "<<beginOptional>>":
                    depth += 1
                    skip = skip or (depth if r.random() < 0.5 else 0)
                elif part == "<<endOptional>>":
                    skip = 0 if skip == depth else skip
                    depth -= 1
                elif skip:
                    continue
                elif part.startswith("<<var"):
                    words += [r.choice(["acme", "inc", "end", "the"]) for _ in range(r.randrange(0, 10))]
                else:
                    words += licenses.words_of(part)
            if r.random() < 0.4 and words:
                words[r.randrange(len(words))] = "other"
            words += ["tail"] * r.randrange(3)
            want = max((k for k in range(1, len(words) + 1) if pattern.fullmatch("".join(w + " " for w in words[:k]))), default=0)
            assert machine.run(np.array([hash_of(w) for w in words], np.uint64)) == want, (label, words)
            seen += want > 0
        assert seen > 0, label


def test_licenses_like_a_plain_scan(spark, tmp_path):
    from newsloom.llm import licenses

    for name, text in {"one.template.txt": "made by <<var;words=1..2>> for all", "two.txt": "made <<beginOptional>>well <<endOptional>>by hand"}.items():
        (tmp_path / name).write_text(text)
    templates = licenses.read_templates(spark, f"file://{tmp_path}")
    assert sorted(templates) == ["one", "two"]
    r = random.Random(5)
    texts = [" ".join(r.choice(["made", "by", "well", "hand", "for", "all", "x", "cc"]) for _ in range(r.randrange(40))) for _ in range(200)] + [None, "", "made by hand", "made"]
    rows = licenses.scan_licenses(docs(spark, texts).repartition(3), templates=templates).collect()
    patterns = {k: template_regex(v) for k, v in templates.items()}
    for x in rows:
        w = licenses.words_of(texts[x.doc_id] or "")
        found = []
        for at in range(len(w)):
            for label, p in patterns.items():
                n = max((k for k in range(1, 10) if at + k <= len(w) and p.fullmatch("".join(v + " " for v in w[at : at + k]))), default=0)
                found += [(at, label, n)] if n else []
        assert sorted((s.start, s.label, s.n_words) for s in x.spans) == sorted(found)
        base = {lab for p, lab in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()}
        assert x.labels == ",".join(sorted(base | {f[1] for f in found})) and x.score == (1.0 if found else 0.5 if base else 0.0)


# 6 -----------------------------------------------------------------------------------------------
def test_warc_round_trip(spark):
    from newsloom.llm import warc

    big = "<p>é" + "x" * 200 + "</p>"
    rows = [(1, "http://a/", big), (2, "http://b\r\n/", big), (3, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 100_000), (2, "again", big), (8, "u", "\r\n\r\nWARC/1.1\r\n" + "z" * 100), (None, "u", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    records = warc.plan_records(pages)
    for dictionary in (b"", warc.train_dictionary(warc.plan_records(spark.read.parquet(f"{SF}/pages.parquet")))):
        out = warc.read_archives(warc.write_archives(records, dictionary)).collect()
        key = lambda x: (x.page_id is None, x.page_id, x.payload_bytes)
        want = sorted(((i is None, i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if h == big and i != 1 else "response", 1 if h == big and i != 1 else None) for i, _, h in rows), key=str)
        assert sorted(((*key(x), x.payload_digest, x.record_type, x.refers_to) for x in out), key=str) == want
        assert all(x.error is None for x in out)
    assert warc.read_archives(warc.write_archives(records.where("false"), b"")).count() == 0


def test_warc_errors():
    from newsloom.llm import warc

    good = warc.build_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert warc.parse_record(good)["error"] is None
    assert warc.parse_record(good.replace(b"WARC/1.1", b"HTTP/1.1"))["error"] and warc.parse_record(good[:-1])["error"] and warc.parse_record(good.replace(b"abc\r\n", b"abd\r\n"))["error"]
    assert warc.parse_record(good.replace(b"WARC-Date", b"WARC-Dote"))["error"] and warc.parse_record(b"")["error"]


def test_warc_broken_archives(spark, tmp_path):
    import io
    import struct

    import zstandard as zstd

    from newsloom.llm import warc

    samples = [b"<html><body>" + bytes([97 + i % 26]) * 40 + b"page number %d" % i for i in range(200)]
    dictionary = zstd.train_dictionary(2000, samples).as_bytes()
    build = lambda i: warc.build_record(i, "u", samples[i], hashlib.sha256(samples[i]).hexdigest(), None)
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(dictionary))
    body = [packer.compress(build(i)) for i in range(3)]
    for raw in (dictionary, zstd.ZstdCompressor().compress(dictionary)):
        head = struct.pack("<II", warc.SKIPPABLE, len(raw)) + raw
        got = list(warc.records(io.BytesIO(head + b"".join(body)).read, 3))
        assert [x["page_id"] for x in got] == [0, 1, 2] and not any(x["error"] for x in got)
    cut = {"cut": head + body[0] + body[1][:-3], "noise": head + body[0] + b"noise and no frame at all", "dictionary": head[:50], "missing": head + body[0] + body[1], "empty": b""}
    for name, raw in cut.items():
        (tmp_path / name).write_bytes(raw)
    manifest = spark.createDataFrame([(str(tmp_path / k), 3, f"file://{tmp_path}") for k in cut], "path string, n_records long, root string")
    rows = warc.read_archives(manifest).collect()
    errors = sorted(x.error for x in rows if x.error)
    assert len(rows) - len(errors) == 1 + 1 + 0 + 2 and len(errors) == 5
    assert errors[:2] == ["after 0 records: 3 records expected", "after 0 records: the archive ends inside the dictionary"] and errors[4] == "after 2 records: 3 records expected"
    assert errors[2] == "after 1 records: the archive ends inside a frame" and errors[3].startswith("after 1 records: zstd")


# 7 and 10 ----------------------------------------------------------------------------------------
def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    from newsloom.llm import langid

    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.learn(d)
    rows = langid.predict(d, model).join(d.select("doc_id", "lang"), "doc_id").collect()
    own = [x.lang_pred == x.lang for x in rows if held(x.doc_id)]
    assert len(rows) == 1000 and np.mean(own) > 0.98 and all(0 <= x.score <= 1 for x in rows)
    odd = docs(spark, [None, "", "123 ...", "Привет мир", "the and that with " * 5 + "Ökeit und der nicht die lich " * 5, "the " * 30000]).withColumnRenamed("n_chars", "score")
    got = {x.doc_id: x for x in langid.predict(odd, model).collect()}
    assert [got[i].lang_pred for i in range(3)] == ["und"] * 3 and got[3].lang_pred in model.langs and got[3].score == 0
    assert [s.lang for s in got[4].spans] == ["en", "de"] and got[5].lang_pred == "en"
    assert {x.doc_id for x in langid.keep_known(odd, model).collect()} == {4, 5}
    none = langid.learn(d.where("false"))
    assert langid.predict(odd, none).where("lang_pred <> 'und'").count() == 0


def test_viterbi_is_optimal():
    from newsloom.llm.langid import viterbi

    r = np.random.default_rng(1)
    for _ in range(60):
        rows = np.concatenate([[0], np.cumsum(r.integers(0, 40, r.integers(1, 14)))])
        s = r.normal(0, 3, (rows[-1], 4))
        lab = viterbi(s, rows, 4.0)
        for a, b in zip(rows[:-1], rows[1:]):
            if b > a:
                v = s[a]
                for t in range(a + 1, b):
                    v = (v[:, None] - 4.0 * (1 - np.eye(4))).max(0) + s[t]
                got = s[np.arange(a, b), lab[a:b]].sum() - 4.0 * (lab[a + 1 : b] != lab[a : b - 1]).sum()
                assert abs(v.max() - got) < 1e-9


def test_quality(spark):
    from pyspark.sql import functions as F

    from newsloom.llm import gam

    d, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = gam.learn(d, labels)
    rows = gam.score(d, model).join(labels, "doc_id").where("quality is not null").collect()
    own = [(x.score >= 0.7) == (x.quality == 1) for x in rows if held(x.doc_id)]
    assert np.mean(own) > 0.93 and len(model.pairs) > 0
    odd = docs(spark, [None, "", "!", "A" * 100_000, "x\n" * 500]).withColumnRenamed("source", "score")
    got = gam.score(odd, model).collect()
    assert len(got) == 5 and all(0 <= x.score <= 1 for x in got) and gam.keep_good(odd, model).columns == odd.columns
    wide = labels.select("doc_id", F.col("quality").cast("long").alias("quality")).union(labels.select("doc_id", F.lit(None).cast("long"))).union(labels.select("doc_id", F.col("quality").cast("long")))
    again = gam.learn(d, wide)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))
    plain = gam.learn(d, labels.where("false"))
    assert gam.score(odd, plain).where(F.col("score") < 0.7).count() == 0
    assert gam.keep_good(odd, plain).count() == 5


MASK = (1 << 64) - 1


def plain_mix(h):
    for _ in range(2):
        h = (h ^ (h >> 32)) * 0xD6E8FEB86659FD93 & MASK
    return h ^ (h >> 32)


def test_language_like_a_plain_model(spark):
    """Counting, scores and labels of texts by loops over words and letters."""
    import regex

    from newsloom.llm import langid

    r = random.Random(3)
    words = {"xx": ["abra", "kada", "bra", "ab", "\u00c9t\u00e9"], "yy": ["zyx", "zzy", "xyz", "yx"], "cc": ["\u041c\u0438\u0440", "\u043f\u0440\u0438\u0432\u0435\u0442"]}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(r.randrange(1, 30))), lang, "s", 0) for i in range(120) for lang in [r.choice(list(words))]]
    rows += [(200, None, "xx", "s", 0), (201, "abra", None, "s", 0), (202, "", "xx", "s", 0)]
    df = spark.createDataFrame(rows, DOC).repartition(3)
    model = langid.learn(df)

    def grams(word):
        out = []
        for k in range(len(word)):
            for n in (1, 2, 3):
                key = 0
                for m in range(n):
                    at = k - m
                    q = ord(word[at]) if at >= 0 else 1 if at == -1 else 0
                    key = (key * 0x110000 + q + m) & MASK
                out.append(plain_mix((key + ((n - 1) << 62)) & MASK) % langid.BUCKETS)
        return out

    def whole(word):
        up = total = 0
        base = 0x9E3779B97F4A7C15
        for k, c in enumerate(word):
            up = pow(base, k + 1, 1 << 64)
            total = (total + plain_mix(ord(c) + 1) * up) & MASK
        return plain_mix(total) % langid.BUCKETS

    split = lambda t: regex.findall(r"\p{L}+", (t or "").lower())
    counts = {}
    for i, t, lang, *_ in rows:
        if lang and not held(i):
            for w in split(t):
                for b in grams(w):
                    counts[b, lang] = counts.get((b, lang), 0) + 1
                counts[whole(w), lang] = counts.get((whole(w), lang), 0) + 2
    langs = sorted({lang for _, lang in counts})
    assert model.langs == langs
    total = {lang: sum(n for (_, x), n in counts.items() if x == lang) for lang in langs}
    for b in {b for b, _ in counts}:
        logs = [np.log((counts.get((b, x), 0) + 0.5) / (total[x] + 0.5 * langid.BUCKETS)) for x in langs]
        assert np.allclose(model.table[b], np.array(logs) - np.mean(logs), atol=1e-5)
    texts = [" ".join(r.choice(words[r.choice(list(words))]) for _ in range(r.randrange(1, 9))) for _ in range(60)] + ["123", "abra 7 " * 5 + "zyx " * 6]
    got, score, _ = langid.predict_texts(pa.array(texts), model)
    cyrillic = langs.index("cc")
    for t, lang, sc in zip(texts, got, score):
        own = split(t)
        if not own:
            assert (lang, sc) == ("und", 0)
            continue
        each = []
        for w in own:
            v = sum(model.table[b] for b in grams(w)) / 2 + 2 * model.table[whole(w)]
            inside = "\u0400" <= w[0] < "\u0530"
            each.append([v[k] if (k == cyrillic) == inside else -50.0 for k in range(len(langs))])
        best = {k: (each[0][k], [k]) for k in range(len(langs))}
        for v in each[1:]:
            best = {k: max(((b - (model.switch if j != k else 0) + v[k], [*path, k]) for j, (b, path) in best.items()), key=lambda x: x[0]) for k in range(len(langs))}
        path = max(best.values(), key=lambda x: x[0])[1]
        weight = [sum(len(w) for w, k in zip(own, path) if k == x) for x in range(len(langs))]
        assert lang == langs[weight.index(max(weight))] and abs(sc - max(weight) / sum(map(len, own))) < 1e-9


def plain_features(text):
    data, words = (text or "").encode(), re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    lines = [x for x in data.split(b"\n") if x]
    n, size = len(words), len(data)
    count = lambda chars, of: sum(c in chars for c in of)
    upper, letters = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", data) + sum(c >= 128 for c in data)
    low = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    lows = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in lines]
    w1, l1, s1, symbols = max(n, 1), max(len(lines), 1), max(size, 1), rb"#$%&*<>{}[]=+~^_\/@"
    triples = len({tuple(low[i : i + 3]) for i in range(n - 2)})
    return [
        np.log1p(n), sum(map(len, words)) / w1, count(upper, data) / max(letters, 1), count(b"0123456789", data) / s1, count(symbols, data) / s1, count(b"!?", data) / w1, count(b".,;:", data) / w1, count(b"|", data) / w1, count(b"\n", data) / w1,
        len(set(low)) / w1, 1 - len(set(lows)) / l1, max((low.count(w) for w in set(low)), default=0) / w1, triples / max(n - 2, 1), sum(c >= 128 for c in data) / s1, sum(len(w) == 1 for w in words) / w1, n / (count(b".", data) + 1),
        sum(w[0] in upper for w in words) / w1, n / l1, sum(w[-1] in symbols for w in words) / w1, letters / s1,
    ]


def test_quality_features_and_scores_like_loops():
    from newsloom.llm import gam

    r = random.Random(8)
    al = list("aAbBzZ09 .,!?|#@\\/\n\t") + ["\u00e9", "\u65e5", "the ", "The\n", "the the the "]
    texts = ["", " ", "A", "\n\n", "x" * 50] + ["".join(r.choice(al) for _ in range(r.randrange(120))) for _ in range(150)]
    got = gam.text_features(pa.array(texts))
    assert got.shape == (len(texts), len(gam.FEATURES)) and np.allclose(got, [plain_features(t) for t in texts])
    x = np.random.default_rng(2).random((400, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    m = gam.fit(x, y, rounds=10, pair_rounds=10)
    for row, p in zip(x, m.score(x)):
        b = [sum(v >= e for e in edges) for v, edges in zip(row, m.edges)]
        z = m.start + sum(t[k] for t, k in zip(m.tables, b)) + sum(g[b[i] // m.coarse][b[j] // m.coarse] for (i, j), g in zip(m.pairs, m.grids))
        assert abs(p - 1 / (1 + np.exp(-z))) < 1e-9
    assert np.mean((m.score(x) > 0.5) == (y > 0.5)) > 0.9


def test_trees_find_the_best_cuts():
    from newsloom.llm import gam

    r = np.random.default_rng(6)
    gain = lambda g, h: g.sum() ** 2 / (h.sum() + 1)

    def best_cut(g, h, least):
        found = [(gain(g[:k], h[:k]) + gain(g[k:], h[k:]) - gain(g, h), k) for k in range(1, len(g)) if h[:k].sum() > least and h[k:].sum() > least]
        return max(found, key=lambda f: f[0]) if found else (0, 0)

    for _ in range(200):
        n = int(r.integers(1, 12))
        g, h = r.normal(size=n), r.random(n) * 3
        out = np.zeros(n)
        top, k = best_cut(g, h, 1.0)
        for a, b in [(0, n)] if top <= 1e-12 else [(0, k), (k, n)]:
            inner, j = best_cut(g[a:b], h[a:b], 1.0)
            for x, y in [(a, b)] if inner <= 1e-12 else [(a, a + j), (a + j, b)]:
                out[x:y] = g[x:y].sum() / (h[x:y].sum() + 1)
        assert np.allclose(gam._tree(g, h, 1.0), out)
        gg, hh = r.normal(size=(n, n)), r.random((n, n)) * 3
        grid, total = gam._pair_tree(gg, hh, 1.0)
        options = []
        for a, b in ((gg, hh), (gg.T, hh.T)):
            _, k = best_cut(a.sum(1), b.sum(1), 1.0)
            k = k or n // 2
            value, table = 0.0, np.zeros((n, n))
            for lo, hi in ((0, k), (k, n)):
                _, j = best_cut(a[lo:hi].sum(0), b[lo:hi].sum(0), 1.0)
                for c, d in ((0, j), (j, n)) if j else ((0, n),):
                    value += gain(a[lo:hi, c:d], b[lo:hi, c:d])
                    table[lo:hi, c:d] = a[lo:hi, c:d].sum() / (b[lo:hi, c:d].sum() + 1)
            options.append((value, table if a is gg else table.T))
        assert abs(total - max(v for v, _ in options)) < 1e-9 and any(np.allclose(grid, t) and abs(v - total) < 1e-9 for v, t in options)


# 8 -----------------------------------------------------------------------------------------------
def test_chat_round_trip(spark):
    from newsloom.llm import chat

    control = "<|im_end|><|im_start|>assistant ok ~ ~0 ~1 ~~<| <"
    rows = [(1, 0, "user", control), (1, 1, "assistant", control), (2, 1, "assistant", "b"), (2, 0, "user", None), (3, 0, None, "x\n\n"), (3, 1, "we\nird~<|", ""), (4, 0, "system", "s"), (4, 1, "assistant", "a"),
            (None, 0, "user", "n"), (5, 0, "user", "u"), (5, 1, "assistant", "r"), (5, 1, "assistant", "r"), (6, 0, "user", "é" * 50_000), (6, 1, "assistant", "日本 ok")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int").repartition(4)
    got = {x.conv_id: x for x in chat.read_chats(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        turns = sorted(((t, ro or "", te or "") for i, t, ro, te in rows if i == c))
        assert [(x.role, x.text) for x in got[c].turns] == [(ro, te) for _, ro, te in turns]
        assert got[c].loss_text == "".join(te for _, ro, te in turns if ro == "assistant") and "".join(s.text for s in got[c].segments) == got[c].formatted
    assert {c for c, x in got.items() if x.valid} == {1, 2, 6}
    assert chat.format_chats(df.where("false")).count() == 0


# pipeline ----------------------------------------------------------------------------------------
def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names and empty tables, each stage against a plain rule."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    from newsloom.llm import gam, langid
    from newsloom.llm.common import table

    known = table(spark, SF, "documents")
    good = [x.text for x in known.limit(40).collect() if x.text]
    item = next(x.text for x in table(spark, SF, "benchmark").collect() if x.text and len(x.text.split()) > 12)
    texts = [None, "", " \n\t", "123 456", good[0], good[0], good[1] + " " + item + " " + good[2], (good[3] + " ") * 300, *good[4:12]]
    rows = [(i if i != 3 else None, t, None if i % 3 else "en", None if i % 2 else "s", None if i % 5 else 1, "x", 1, None) for i, t in enumerate(texts)]
    rows += [rows[4], rows[8]]
    odd = spark.createDataFrame(rows, DOC + ", hit_spans string, score int, gone string").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    d = odd.unionByName(known.withColumns({"hit_spans": F.lit("k"), "score": F.lit(0), "gone": F.lit(None).cast("string")}).where("doc_id >= 100"))
    every = d.collect()
    key = lambda x: (x.doc_id, x.text, x.hit_spans)
    counts = lambda found: {k: sum(key(x) == k for x in found) for k in map(key, found)}
    out = {name: stages[name](spark, d, SF) for name in stages}
    assert all(out[n].columns == d.columns for n in stages if n != "tokens")
    model = gam.learn(d, table(spark, SF, "labels"))
    assert counts(out["quality"].collect()) == counts([x for x, s in zip(every, model.score(gam.text_features(pa.array([x.text or "" for x in every])))) if s >= 0.7])
    langs, score, _ = langid.predict_texts(pa.array([x.text or "" for x in every]), langid.learn(d))
    assert counts(out["language"].collect()) == counts([x for x, lang, s in zip(every, langs, score) if lang != "und" and s >= 0.5])
    best = {}
    for x, (_, _, c, _) in zip(every, near_brute([x.text for x in every])):
        if x.doc_id is not None:
            best.setdefault(c, set()).add(x.doc_id)
    gone = {i for ids in best.values() for i in ids if i != min(ids)}
    assert counts(out["near_duplicates"].collect()) == counts([x for x in every if x.doc_id is None or x.doc_id not in gone])
    items = [(x.item_id, x.text) for x in table(spark, SF, "benchmark").collect()]
    hit = contaminated_brute([x.text for x in every], items)
    assert counts(out["decontamination"].collect()) == counts([x for x, h in zip(every, hit) if not h[5]])
    _, t = tokenizer()
    want = sorted((x.doc_id or -1, len(t.encode(x.text or "", add_special_tokens=False).ids)) for x in every)
    assert sorted((x.doc_id or -1, x.n_tokens) for x in out["tokens"].collect()) == want
    assert all(stages[n](spark, odd.where("false"), SF).count() == 0 for n in stages)


def test_pipeline_stages(spark):
    import corpus_pipeline
    from newsloom.llm import decontaminate, gam, langid
    from newsloom.llm.common import table, written

    d = table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = {x.doc_id: x for x in d.collect()}
        d = written(stage(spark, d, SF), "test-stage")
        after = [x.doc_id for x in d.collect()]
        assert len(after) == len(set(after)) and set(after) <= set(before)
        if name != "tokens":
            assert d.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = sorted(before)
        texts = [before[i].text for i in ids]
        if name == "near_duplicates":
            assert set(after) == {ids[g[0]] for g in near_brute(texts) if g[3]}
        elif name == "decontamination":
            items = [(x.item_id, x.text) for x in table(spark, SF, "benchmark").collect()]
            assert set(after) == {ids[g[0]] for g in contaminated_brute(texts, items) if not g[5]}
        elif name == "tokens":
            assert set(after) == set(before)
    assert gam and langid and decontaminate
