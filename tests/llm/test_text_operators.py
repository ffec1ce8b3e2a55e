"""Quality rules, packing, SimHash and quality model against brute force."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from assayer.llm import packing, quality_model, quality_rules, queries, simhash
from assayer.llm.common import in_training, labels_of, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(windows)
    covered = {j for i, x in enumerate(windows) if seen[x] > 1 for j in (i, i + 1, i + 2)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def check_counts(rows, docs):
    got = sorted(((r["doc_id"], *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for r in rows), key=str)
    assert got == sorted(((d["doc_id"], *counts(d["text"])) for d in docs), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_quality_rules_match_brute_force(llm, sf):
    rows = queries.op3_quality_rules(llm, sf).collect()
    check_counts(rows, table(llm, sf, "documents").collect())
    kept = {r["doc_id"]: r["kept"] for r in rows}
    y = {r["doc_id"]: r["quality"] for r in table(llm, sf, "labels").collect()}
    good = [kept[i] for i in y if y[i] == 1]
    assert not any(kept[i] for i in y if y[i] == 0) or np.mean(good) > 0.8


def test_quality_rules_odd_rows(llm, odd):
    check_counts(quality_rules.quality_rules(odd).collect(), odd.collect())
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_cascade_order_and_verdict(llm):
    df = quality_rules.base_counts(llm.createDataFrame([(1, "a b! c$"), (2, "1 2 3")], "doc_id int, text string")).checkpoint()
    order = [r for r, _, _ in quality_rules.plan(df)]
    assert {r.name for r in order} == {r.name for r in quality_rules.RULES}
    for rules in (order, order[::-1]):
        assert [r["kept"] for r in quality_rules.cascade(df, rules, F.lit(True)).orderBy("doc_id").collect()] == [False, False]


def check_packing(pieces, docs):
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(TOKENIZER)
    want = Counter()
    for d in docs:
        ids = np.array([*code.encode(d["text"] or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        want[d["doc_id"], ids] += 1
    by, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    got = Counter()
    for doc_id, parts in by.items():
        parts.sort(key=lambda p: (p["start"], p["sequence_id"], p["offset"]))
        totals = [p["doc_tokens"] for p in parts if p["start"] == 0]
        if len(totals) == 1:
            assert [p["start"] for p in parts] == list(np.cumsum([0, *(p["length"] for p in parts)])[:-1])
            got[doc_id, b"".join(bytes(p["ids"]) for p in parts)] += 1
    assert all(want[k] for k in got)
    assert sum(p["length"] for p in pieces) == sum(len(k[1]) // 4 * n for k, n in want.items())
    used = 0
    for parts in windows.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0, *(n for _, n in parts)])[:-1])
        size = sum(n for _, n in parts)
        assert 0 < size <= 4096
        used += size if size & (size - 1) == 0 else 4096
    return sum(p["length"] for p in pieces) / used


def test_packing_round_trip(llm, sf):
    docs = table(llm, sf, "documents")
    assert check_packing(packing.pack(docs, TOKENIZER).collect(), docs.collect()) > 0.97
    row = queries.op6_packing(llm, sf).first()
    assert row["ids_crc32"] >= 0 and row["length"] > 0


def test_other_tokenizers_encode_whole_texts(llm):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some Text,  with  blanks\nand Lines\t" * 3
    assert not packing.encoder(path).by_parts and packing.encoder(TOKENIZER).by_parts
    rows = packing.pack(llm.createDataFrame([("a", text), ("b", None)], "doc_id string, text string"), path).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in rows] == ["a", "b"] and len({r["sequence_id"] for r in rows}) <= 2
    assert np.frombuffer(rows[0]["ids"], "<u4").tolist() == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 2]


def test_packing_odd_rows(llm, odd):
    check_packing(packing.pack(odd, TOKENIZER).collect(), odd.collect())
    assert packing.pack(odd.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["I'll don't <|endoftext|>", "ÇA VA ßtraße İstanbul", "x²   y é", "a\x1cb\x85c", "日本語 don'T 12ab_c-d", "ſ'S ŉ ¿qué?", "'", "a" * 300])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(TOKENIZER).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.encoder(TOKENIZER).encode(text), "<u4").tolist() == want


def slow_rises(level, size, cuts=False):
    """Sum of squares after each way to place a piece: (fill, part placed) to rise; fill 0 opens a window."""
    window, rise = len(level) - 1, {}
    for fill in range(window):
        if fill and not level[fill]:
            continue
        part = min(size, window - fill) if cuts else size
        if fill + part <= window:
            after = level.copy()
            after[fill] -= bool(fill)
            after[fill + part] += fill + part < window
            rise[fill, part] = int((after**2).sum() - (level**2).sum())
    return rise


def test_sum_of_squares_choice():
    packer = packing.Packer(8)
    rng = np.random.default_rng(3)
    done, total = [], 0
    for i in range(200):
        size = int(rng.integers(1, 8))
        total += size
        rises = slow_rises(packer.level, size)
        assert rises[packer.choose(size), size] == min(rises.values())
        done += packer.add((i, 0), size)
    tail = list(packer.close())
    sizes = [sum(n for _, n in w) for w in [*done, *tail]]
    assert sum(sizes) == total and sorted(sizes)[1:] == [8] * (len(sizes) - 1)


@pytest.mark.parametrize("partitions", [1, 8, 32])
def test_every_piece_is_placed_by_the_rule(partitions, monkeypatch):
    """At a partition's end as well: each piece goes where the sum rises least, and no window is opened needlessly."""
    rng = np.random.default_rng(partitions)
    put, seen = packing.Packer.put, Counter()

    def checked(self, fill, piece, size):
        key, start = piece
        if closing[0]:
            rises = {k: v for k, v in slow_rises(self.level, left[key] - start, cuts=True).items() if k[0] or not self.level.any()}
            assert (fill, size) in rises and rises[fill, size] == min(rises.values())
            seen["closing"] += 1
        seen["all"] += 1
        return put(self, fill, piece, size)

    monkeypatch.setattr(packing.Packer, "put", checked)
    for _ in range(partitions):
        closing, left, packer = [False], {}, packing.Packer(64)
        out = []
        for i in range(320 // partitions):
            left[i] = int(rng.integers(1, 64))
            out += packer.add((i, 0), left[i])
        closing[0] = True
        # Pieces that were cut before closing keep their own ends.
        out += packer.close()
        assert sum(n for w in out for _, n in w) == sum(left.values())
        assert sorted(sum(n for _, n in w) for w in out)[1:] == [64] * (len(out) - 1)
    assert seen["closing"]


def brute_classes(docs):
    codes = [simhash_of(d["text"]) for d in docs]
    ids = [d["doc_id"] for d in docs]
    distinct = sorted(set(codes))
    arr, label = np.array(distinct, np.uint64), {c: c for c in distinct}

    def root(c):
        while label[c] != c:
            c = label[c]
        return c

    for i, c in enumerate(distinct):
        for j in np.flatnonzero(np.bitwise_count(arr ^ np.uint64(c)) <= 2):
            a, b = root(c), root(distinct[j])
            label[max(a, b)] = min(a, b)
    least = {}
    for i, c in zip(ids, codes):
        if i is not None:
            least[root(c)] = min(least.get(root(c), i), i)
    return sorted(((i, f"{c:016x}", least.get(root(c))) for i, c in zip(ids, codes)), key=str)


def simhash_of(text):
    w = [x.translate({i: i + 32 for i in range(65, 91)}) for x in WORD.findall(text or "")]
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_matches_brute_force(llm, sf):
    got = sorted((tuple(r) for r in queries.op8_simhash_dedup(llm, sf).collect()), key=str)
    assert got == brute_classes(table(llm, sf, "documents").collect())


def test_simhash_odd_rows(llm, odd):
    got = sorted((tuple(r) for r in simhash.digest(simhash.near_duplicates(odd)).collect()), key=str)
    assert got == brute_classes(odd.collect())
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([None, 1, 2, 5, 7], key=str)
    words = " ".join(f"w{i}" for i in range(40))
    mixed_ids = llm.createDataFrame([(1, words), (1, "another text"), (2, words), (2, "a third text"), (2, "a third text"), (3, "another text")], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(mixed_ids).collect())) == [(1, "another text"), (1, words), (2, "a third text")]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_similar_texts_go_beyond_the_radius(llm):
    rng = np.random.default_rng(4)
    rows, words = [], [f"w{i}" for i in range(3000)]
    for i in range(60):
        base = list(rng.choice(words, 100))
        rows += [(i, " ".join(base)), (100 + i, " ".join([*base[:50], "changed", *base[51:]])), (200 + i, " ".join([*base[:20], "a", *base[21:50], "b", *base[51:80], "c", *base[81:]]))]
    df = llm.createDataFrame([*rows, (900, None), (901, " "), (None, "x y")], "doc_id long, text string")
    assert 0.8 <= simhash.jaccard_of(rows[0][1], rows[1][1]) and simhash.jaccard_of(rows[0][1], rows[2][1]) < 0.8
    far = [(simhash.fingerprint_of(rows[3 * i][1]) ^ simhash.fingerprint_of(rows[3 * i + 1][1])).bit_count() for i in range(60)]
    assert np.median(far) > 2
    kept = sorted((r["doc_id"] for r in simhash.keep_one(df).collect()), key=str)
    assert kept == sorted([*range(60), *range(200, 260), 900, None], key=str)


def test_similar_texts_match_brute_force(llm, sf):
    docs = {r["doc_id"]: r["text"] for r in table(llm, sf, "documents").collect()}
    sets = {i: set(simhash.hashes_of(t, 5).tolist()) for i, t in docs.items()}
    label = {i: i for i in docs}
    for i in sorted(docs):
        for j in docs:
            if j > i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(table(llm, sf, "documents")).collect()} == label


def test_bk_trees_find_all_links_in_dense_groups():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 5, dtype=np.int64).astype(np.uint64)
    codes = base[rng.integers(0, 5, 600)]
    for _ in range(3):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64))
    codes = np.unique(codes)
    trees = simhash.Trees(codes, np.zeros(len(codes), np.int64))
    found = {(int(trees.codes[a]), int(trees.codes[b])) for q, n in trees.links(2, 64) for a, b in zip(q, n)}
    far = np.bitwise_count(codes[:, None] ^ codes[None])
    assert found == {(int(codes[i]), int(codes[j])) for i, j in np.argwhere((far <= 2) & (far > 0))}


def test_trees_propose_every_pair_of_a_dense_group_once():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (5, 64 * simhash.CODES)).astype(np.uint8)
    bits = base[rng.integers(0, 5, 600)] ^ (rng.random((600, 64 * simhash.CODES)) < 0.1)
    bits[:40] = bits[0]
    sketches = pd.Series([np.packbits(b, bitorder="little").tobytes() for b in bits])
    keys, node, label = simhash.tables(600), rng.permutation(600), rng.integers(0, 4, 600)
    buckets, codes = simhash.placed(sketches, keys)
    rows = pd.concat([pd.DataFrame({"node": node, "label": label, "sketch": sketches, "bucket": buckets[:, t], "code": codes[:, t]}) for t in range(len(keys))])
    got = list(zip(*(x.tolist() for x in simhash.apart(rows.sample(frac=1, random_state=1), 16, keys, 185))))
    near = np.array([(bits ^ x).sum(axis=1, dtype=int) <= 185 for x in bits]) & (label[:, None] != label)
    meet = sum((buckets[:, t, None] == buckets[:, t]) & (np.bitwise_count(codes.view(np.uint64)[:, t, None] ^ codes.view(np.uint64)[:, t]) <= 16) for t in range(len(keys)))
    assert sorted(got) == sorted((node[i], node[j]) for i, j in np.argwhere(near & (meet > 0)) if node[i] > node[j])


def test_near_copies_of_one_text_lose_no_link(llm):
    """A group far over any bound on neighbours: similar to few others each, in components that brute force gives."""
    rng = np.random.default_rng(11)
    base, texts = [f"w{i}" for i in range(150)], []
    for i in range(400):
        changed = list(base)
        for at in rng.integers(0, 150, rng.integers(1, 9)):
            changed[at] = f"c{i}x{at}"
        texts.append(" ".join(changed))
    sets = [set(simhash.hashes_of(t, 5).tolist()) for t in texts]
    label = list(range(400))
    for i in range(400):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert 1 < len(set(label)) < 300
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_first_pairs_are_few_for_each_near_copy(llm, monkeypatch):
    """Tables deal no sketches for them, and each node proposes its nearest of all tables."""
    base, proposed, by_node, dealt, names = [f"w{i}" for i in range(150)], [], simhash._by_node, simhash.dealt, []
    texts = [" ".join([*base[: i % 140], f"c{i}", *base[i % 140 + 1 :]]) for i in range(420)]
    monkeypatch.setattr(simhash, "_by_node", lambda pairs, *a: proposed.append(pairs.count()) or by_node(pairs, *a))
    monkeypatch.setattr(simhash, "dealt", lambda *a: names.append((found := dealt(*a)).columns) or found)
    docs = llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(docs).collect()} == {0}
    assert names[0] == ["node", "bucket", "code"] and 0 < proposed[0] <= simhash.FIRST * 420


def test_nodes_of_divided_buckets_are_not_left_out():
    rows = pd.DataFrame({"node": [1, 2, 3, 4], "bucket": [0, 0, 0, 5], "code": [0, 0x7FFFFFFF << 20, 1 + (0x7FFFFFFF << 20), 9]})
    a, b, far = simhash.nearest(rows, 16, 2, part=2)
    assert set(zip(a.tolist(), b.tolist(), far.tolist())) == {(1, 1, 64), (2, 2, 64), (3, 3, 64)}
    a, b, far = simhash.nearest(rows, 16, 2, part=3)
    assert sorted(zip(a.tolist(), b.tolist(), far.tolist())) == [(2, 3, 1), (3, 2, 1)]


def test_pairs_of_equal_codes_are_made_in_blocks():
    n, rng = 3000, np.random.default_rng(6)
    rows = pd.DataFrame({"node": np.arange(n), "bucket": np.zeros(n, np.int64), "label": np.arange(n) % 2, "code": np.zeros(n, np.int64)})
    rows["sketch"] = [rng.bytes(8 * simhash.CODES) for _ in range(n)]
    tracemalloc.start()
    try:
        a, _ = simhash.apart(rows, 16, [np.zeros(0, np.int64)], 185)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not len(a) and peak < 150e6


def test_idle_workers_let_tokens_go():
    path = TOKENIZER
    first = packing.encoder(path)
    packing.release_later(60)
    assert packing.encoder(path) is first and not packing._leaving
    packing.release_later(0.01)
    packing._leaving[0].join(30)
    assert not packing._encoders


def test_components_of_long_chains_and_divided_buckets(llm):
    chain = [(i + 1, i) for i in range(40)] + [(101, 100), (102, 101)]
    got = dict(map(tuple, simhash.components(llm.createDataFrame(chain, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}
    codes = [(1 << i) ^ (1 << j) for i in range(64) for j in range(i)]
    codes = llm.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    found = simhash.components(simhash.links(codes, bucket_rows=20))
    assert found.count() == 64 * 63 // 2 - 1 and found.select("b").distinct().count() == 1


def test_quality_model_held_out_accuracy(llm, sf):
    rows = {r["doc_id"]: r for r in queries.op10_quality_model(llm, sf).collect()}
    held = table(llm, sf, "labels").where(~in_training(F.col("doc_id"))).collect()
    right = [rows[r["doc_id"]]["kept"] == bool(r["quality"]) for r in held]
    assert len(rows) == table(llm, sf, "documents").count() and np.mean(right) > 0.9
    assert all(0 <= r["posterior"] <= 1 for r in rows.values())


def test_quality_model_odd_rows(llm, odd, sf):
    labels = llm.createDataFrame([(1, 1), (2, 0), (5, 1)], "doc_id long, y int")
    assert quality_model.quality(odd, labels).count() == odd.count()
    kept = quality_model.keep_good(odd, labels, threshold=0.0)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert quality_model.keep_good(odd, labels.limit(0)).count() == odd.count()
    assert quality_model.keep_good(odd.limit(0), labels).count() == 0


def test_posteriors_worked_out_by_hand(llm):
    model = quality_model.Model((0.0,) * len(quality_model.MEASURES), 0.0, 0.7)
    rng = np.random.default_rng(6)
    rows = [(f"h{i % 4}", f"p{i % 7}", float(rng.normal() + (i % 4) - 1)) for i in range(300)] + [("alone", "p", 1.0)]
    scored = llm.createDataFrame(rows, "_host string, _path string, _logit double")
    p = 1 / (1 + F.exp(-F.col("_logit")))
    sites = quality_model.sites(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))).checkpoint()
    good = lambda x: 1 / (1 + np.exp(-x))
    by = defaultdict(list)
    for h, q, x in rows:
        by[h, q].append(good(x))
    total = [x for v in by.values() for x in v]
    mean = np.mean(total)
    host = {h: [x for (g, _), v in by.items() if g == h for x in v] for h in {h for h, _ in by}}
    var_h = sum((np.mean(host[h]) - mean) ** 2 * len(v) for (h, _), v in by.items()) / len(total)
    strength = lambda v: min(max(mean * (1 - mean) / max(v, 1e-9) - 1, 2.0), 1000.0)
    k_h = strength(var_h)
    prior = {(h, q): (k_h * mean + sum(host[h]) - sum(v)) / (k_h + len(host[h]) - len(v)) for (h, q), v in by.items()}
    k_p = strength(sum((np.mean(v) - prior[k]) ** 2 * len(v) for k, v in by.items()) / len(total))
    for r in quality_model.posterior(scored, sites, model).collect():
        own, path = good(r["_logit"]), by[r["_host"], r["_path"]]
        above = prior[r["_host"], r["_path"]]
        below = (k_p * above + sum(path) - own) / (k_p + len(path) - 1)
        odds = np.exp(r["_logit"]) / (0.7 / 0.3) * below / (1 - below)
        assert (r["host_posterior"], r["path_posterior"], r["posterior"]) == pytest.approx((above, below, odds / (1 + odds)))


def test_sparse_sites_shrink_to_the_prior(llm):
    model = quality_model.Model((0.0,) * len(quality_model.MEASURES), 0.0, 0.5)
    rows = [("big", "p", 4.0)] * 200 + [("big", "q", 4.0)] + [("bad", "p", -4.0)] * 200 + [("one", "p", -4.0)]
    scored = llm.createDataFrame(rows, "_host string, _path string, _logit double")
    p = 1 / (1 + F.exp(-F.col("_logit")))
    sites = quality_model.sites(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), p.alias("p"))).checkpoint()
    got = {r["_host"]: r["path_posterior"] for r in quality_model.posterior(scored, sites, model).collect()}
    assert got["bad"] < 0.1 < 0.4 < got["one"] < 0.6 < 0.9 < got["big"]
