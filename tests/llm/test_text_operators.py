import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from weft.llm import chunk_dedup, license_scan, mixing, nbsvm, packing, suffix_dedup, superminhash, toxicity
from weft.llm.common import table

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(rng, n, letters="abcdefghij"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(n))


# Suffix-array dedup.


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(200):
        s = np.array([rng.randint(1, rng.choice([2, 3, 60])) for _ in range(rng.randint(0, 150))], np.int64)
        assert suffix_dedup.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: tuple(s[i:]))


def covered_bytes(raw, length):
    """For each text whether a byte is covered by a string of ``length`` that starts elsewhere too."""
    seen = Counter(hash(x[p : p + length]) for x in raw for p in range(len(x) - length + 1))
    out = []
    for x in raw:
        on = np.zeros(len(x), bool)
        for p in range(len(x) - length + 1):
            if seen[hash(x[p : p + length])] > 1:
                on[p : p + length] = True
        out.append(on)
    return out


def brute_repeats(rows, length, passage=None):
    raw = [(i, (t or "").encode()) for i, t in rows]
    out = []
    for (i, x), on, short in zip(raw, covered_bytes([x for _, x in raw], length), covered_bytes([x for _, x in raw], passage or length)):
        edges = np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))
        out.append((i, len(x), int(on.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(x, np.uint8)[~on])).hexdigest(), int(short.sum())))
    return out


def key(r):
    return [(v is None, str(v)) for v in r]


@pytest.mark.parametrize("block,piece,short", [(suffix_dedup.BLOCK, suffix_dedup.PIECE, None), (300, 64, None), (suffix_dedup.BLOCK, 64, 25), (300, suffix_dedup.PIECE, 25)])
def test_repeated_strings(spark, docs_of, monkeypatch, block, piece, short):
    rng = random.Random(2)
    passage = words(rng, 12)
    rows = [(i, words(rng, 20) + passage[rng.randint(0, 9) :] + words(rng, rng.randint(0, 20), "éàüxyz")) for i in range(40)]
    rows += [(50, ""), (51, None), (52, "short"), (53, "ab " * 60), (54, rows[3][1]), (3, rows[3][1]), (None, rows[5][1]), (55, "é" * 50)]
    made = suffix_dedup.repeated_windows
    rows += [(60 + i, rows[i][1][: 60 + i]) for i in range(5)]
    # Copies, of a size between both lengths, of two ids twice, and inside another text.
    rows += [(70 + i, "thirty bytes, and twice or so.") for i in range(2)] + [(80 + i % 2, rows[7][1]) for i in range(4)] + [(90, "x" + rows[7][1] + "y")]
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda *a, **k: made(*a, **k, block=block))
    monkeypatch.setattr(suffix_dedup, "_keyed", pieces(suffix_dedup._keyed, piece))
    got = suffix_dedup.removed_bytes(docs_of(rows, extra=True), length=40, passage=short).collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute_repeats(rows, 40, short), key=key)


def pieces(made, piece):
    """``made`` with pieces of another size, set in the worker."""

    def of(*args):
        inner = made(*args)

        def run(batches):
            from weft.llm import suffix_dedup

            suffix_dedup.PIECE = piece
            yield from inner(batches)

        return run

    return of


def test_repeated_strings_of_nothing(spark, docs_of):
    got = suffix_dedup.removed_bytes(docs_of([]), passage=200)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"] and got.count() == 0


@pytest.mark.parametrize("run", [lambda d: suffix_dedup.removed_bytes(d, length=40, passage=25), lambda d: suffix_dedup.deduplicate(d, length=40)])
def test_equal_hashes_settle_nothing(spark, docs_of, monkeypatch, run):
    """With codes that make all strings of a length alike, strings that differ are told by their bytes."""
    monkeypatch.setattr(suffix_dedup, "byte_codes", lambda seed: np.full(256, 7, np.uint64))
    with pytest.raises(Exception, match="another seed"):
        run(docs_of([(i, words(random.Random(i), 12)) for i in range(6)])).collect()


def test_another_seed_gives_the_same(spark, docs_of):
    passage = words(random.Random(8), 20)
    docs = docs_of([(i, words(random.Random(i), 9) + passage) for i in range(6)])
    got = [sorted(map(tuple, suffix_dedup.removed_bytes(docs, length=40, seed=seed).collect())) for seed in (suffix_dedup.SEED, 5)]
    assert got[0] == got[1] and all(r[2] >= len(passage) for r in got[0])


def test_claims_that_follow_each_other_become_one(monkeypatch):
    claim = lambda b, e, fs, fd=1: {"b": b, "e": e, "fd": fd, "ft": 2, "fs": fs}
    got = suffix_dedup.merged([claim(20, 60, 120), claim(0, 30, 100), claim(60, 70, 160), claim(80, 90, 180), claim(30, 50, 20), claim(5, 9, 105, 3)])
    assert sorted((c["fd"], c["b"], c["e"], c["fs"]) for c in got) == [(1, 0, 70, 100), (1, 30, 50, 20), (1, 80, 90, 180), (3, 5, 9, 105)]
    # Cut at the parts of the text that is claimed, and put together again.
    monkeypatch.setattr(suffix_dedup, "PART", 64)
    a = bytes(random.Random(1).randrange(256) for _ in range(400))
    x = b"?" * 10 + a[50:350] + b"?"
    rows = next(suffix_dedup._parted([{"d": [7], "t": [0], "c": [[claim(10, 310, 50)]]}]))
    parts = next(suffix_dedup._parts([{"d": [1], "t": [2], "text": [a.decode("latin-1")], "parts": [[]]}]), {"x": []})
    assert parts["x"] == [] and sum(rows["n"]) == 300 and rows["part"] == [0, 1, 2, 3, 4, 5]
    held = [{"b": b, "x": a[64 * p + o : 64 * p + o + n]} for b, p, o, n in zip(rows["b"], rows["part"], rows["off"], rows["n"])]
    suffix_dedup.confirm(x, held)
    with pytest.raises(ValueError, match="seed"):
        suffix_dedup.confirm(x[:200] + b"!" + x[201:], held)


def test_suffix_deduplicate_with_clashing_names(spark):
    passage = words(random.Random(8), 40)
    docs = spark.createDataFrame([(i, f"{i} {passage} {i}", "d", i, 1.5, "x", 7) for i in range(3)] + [(9, None, "n", 0, 0.5, None, 8)], "doc_id bigint, text string, d string, t bigint, p double, _d string, _p int")
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs, length=60).collect()}
    assert out[0]["text"] == f"0 {passage} 0" and passage not in out[2]["text"] and out[9]["text"] is None
    assert all(tuple(r)[2:] == ("d", r["doc_id"], 1.5, "x", 7) for i, r in out.items() if i < 9) and tuple(out[9])[2:] == ("n", 0, 0.5, None, 8)


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 300])
def test_suffix_deduplicate_keeps_the_first(spark, docs_of, monkeypatch, block):
    made = suffix_dedup.repeated_windows
    monkeypatch.setattr(suffix_dedup, "repeated_windows", lambda *a, **k: made(*a, **k, block=block))
    rng = random.Random(3)
    passage = words(rng, 40)
    rows = [(i, words(rng, 10) + " § " + passage + " § " + words(rng, 10)) for i in range(6)]
    out = {r["doc_id"]: r for r in suffix_dedup.deduplicate(docs_of(rows), length=60).collect()}
    assert out[0]["text"] == rows[0][1]
    for i in range(1, 6):
        assert passage not in out[i]["text"] and out[i]["n_chars"] == len(out[i]["text"]) and out[i]["text"].startswith(rows[i][1][:10])
    assert suffix_dedup.deduplicate(docs_of(rows).limit(0)).count() == 0
    assert suffix_dedup.cut_text("aéb".encode(), [(2, 3)]) == "aéb"


# License scans.


def brute_base(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    places = []
    for label, phrase in (("mit", ["mit", "license"]), ("apache", ["apache", "license"]), ("gpl", ["general", "public", "license"])):
        places += [(i, label) for i in range(len(w)) if w[i : i + len(phrase)] == phrase]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_base_counts(spark, docs_of):
    rng = random.Random(5)
    bits = ["MIT", "license", "Apache", "LICENSE,", "general", "public", "mit-license", "é", "x1", "\n", "İ", "the", "license license"]
    rows = [(i, " ".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(80)] + [(90, None), (91, ""), (92, "ÀMIT license MIT\tLicense")]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(rows, extra=True)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(t), t
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_license_fuzzy(spark, docs_of):
    rows = [
        (1, "foo. Permision is hereby granted,\n free of charge, to any prson obtaining a copy of"), (2, "Licensed under the Apach License, Version 2.0!"),
        (3, "redistribution of water in the forms of rain"), (4, "All rights reserved."), (5, "spdx-license-identifier: MIT"), (6, "permission " * 5),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan(docs_of(rows)).collect()}
    assert got[1]["labels"] == "mit-notice" and got[1]["spans"][0]["first"] == 1 and got[1]["spans"][0]["end"] == 14 and got[1]["spans"][0]["edits"] == 2
    assert "apache-notice" in got[2]["labels"] and got[3]["labels"] == "" and got[4]["labels"] == "rights-notice" and got[5]["labels"] == "spdx-notice"
    assert got[6]["labels"] == "" and got[1]["score"] < 1


def test_pigeonhole_misses_nothing():
    import regex

    rng = random.Random(6)
    m = license_scan.Matcher((("x", "released under the mit license"),), 12)
    pattern = regex.compile(r"(?b)\b(?:released under the mit license){e<=2}\b")
    for _ in range(300):
        s = list("released under the mit license")
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(s))
            s[k : k + 1] = rng.choice([[], [rng.choice("abc")], [s[k], rng.choice("xyz")]])
        text = "foo " + "".join(s) + " bar"
        assert bool(m.find(text)) == bool(pattern.search(text))


# Toxicity and quality.


def auc(score, y):
    rank = score.rank()
    n = y.sum()
    return (rank[y].sum() - n * (n + 1) / 2) / (n * (~y).sum())


def test_toxicity_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = toxicity.classify(docs, labels).toPandas()
    assert len(out) == docs.count() and out["score"].between(0, 1).all()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    held = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert ((held["predicted"] == 1) == (held["toxic"] > 0)).mean() > 0.93 and auc(held["score"], held["toxic"] > 0) > 0.8


def test_quality_learns(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = nbsvm.classify(docs, labels).toPandas()
    assert (out["held_out"] == out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out["held_out"]].merge(labels.toPandas(), on="doc_id")
    assert ((held["predicted"] == 1) == (held["quality"] > 0)).mean() > 0.95 and auc(held["score"], held["quality"] > 0) > 0.95


@pytest.mark.parametrize("classify", [toxicity.classify, nbsvm.classify])
def test_classifiers_without_labels_and_on_odd_rows(spark, docs_of, classify):
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    out = classify(docs_of([(1, None), (2, ""), (None, "x"), (2, ""), (3, "word " * 30_000)], extra=True), none).toPandas()
    assert len(out) == 5 and (out["score"] == 0.5).all() and (out["predicted"] == 0).all()
    assert classify(docs_of([(1, "a")]).limit(0), none).count() == 0


def brute_segments(values):
    """Maximal scoring subsequences by definition: split at the best one, again and again."""
    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0.0
            for j in range(i, b):
                total += values[j]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12 or abs(total - best[0]) <= 1e-12 and j - i < best[2] - best[1]):
                    best = (total, i, j)
        if best:
            s, i, j = best
            return split(a, i) + [(i, j + 1, s)] + split(j + 1, b)
        return []

    return split(0, len(values))


def test_segments_equal_brute_force():
    rng = random.Random(7)
    model = toxicity.Model({b"a": 1.07, b"b": 2.31, b"c": 0.53}, 0.41, 1.0, 1.0, 1.0, 0.0)
    for _ in range(200):
        text = [rng.choice([b"a", b"b", b"c", b"x", b"x", b"x"]) for _ in range(rng.randint(0, 25))]
        want = brute_segments([model.terms.get(w, -model.drift) for w in text])
        got = toxicity.segments(text, model)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want] and np.allclose([s for *_, s in got], [s for *_, s in want])


def test_lambda_solves_its_equation():
    p, s = np.array([0.1, 0.9]), np.array([2.0, -0.5])
    lam = toxicity.solve_lambda(p, s)
    assert lam > 0.1 and abs((p * np.exp(lam * s)).sum() - 1) < 1e-6


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(200):
        label = i % 2
        rows.append(np.unique(np.concatenate([rng.integers(0, 50, 8), [100 + label]])).astype(np.int32))
        y.append(1.0 if label else -1.0)
    y = np.array(y)
    r = nbsvm.log_count_ratio(rows, y)
    w, bias = nbsvm.dual_coordinate_descent(rows, r, y)
    margins = np.array([w[x] @ (r[x] / np.linalg.norm(r[x])) + bias for x in rows])
    assert (np.sign(margins) == y).all()


# Packing.


def test_packing(spark, docs_of):
    from tokenizers import Tokenizer

    rng = random.Random(8)
    rows = [(i, ". ".join(words(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "x" * 9000), (73, "<|endoftext|> it's 12  \n\n é日本"), (5, rows[5][1])]
    out = packing.pack(docs_of(rows, extra=True)).toPandas()
    tok = Tokenizer.from_file(packing.default_path())
    tok.encode_special_tokens = True
    left = defaultdict(list)
    for i, t in rows:
        left[i].append(np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], np.uint32))
    # Pieces of one document follow each other in the order of sequences and offsets.
    out = out.sort_values(["sequence_id", "offset"])
    pos = defaultdict(int)
    for r in out.itertuples():
        ids = left[r.doc_id][0]
        assert r.doc_tokens == len(ids) and r.start == pos[r.doc_id] and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        pos[r.doc_id] += r.length
        if pos[r.doc_id] == len(ids):
            left[r.doc_id].pop(0)
            pos[r.doc_id] = 0
    assert not any(left.values())
    sizes = out.groupby("sequence_id")["length"].sum()
    assert (out["offset"] == out.groupby("sequence_id")["length"].cumsum() - out["length"]).all() and sizes.max() <= 1024
    assert packing.pack(docs_of([(1, "a")]).limit(0)).count() == 0


def test_best_cuts_are_optimal():
    rng = random.Random(9)
    for _ in range(150):
        window, places, at = 16, [], 0
        for _ in range(rng.randint(1, 14)):
            at += rng.randint(1, 7)
            places.append(at)
        cost = [rng.choice([0, 2, 5]) for _ in places[:-1]] + [0]
        pad = lambda n: 0 if n & (n - 1) == 0 else window - n

        def value(cuts):
            ends = [0] + [places[j] for j in cuts]
            if any(b - a > window for a, b in zip(ends, ends[1:])):
                return float("inf")
            return sum(pad(b - a) for a, b in zip(ends, ends[1:])) + sum(cost[j] for j in cuts)

        n = len(places)
        best = min(value([j for j in range(n - 1) if m >> j & 1] + [n - 1]) for m in range(1 << n - 1))
        assert value(packing.best_cuts(places, cost, window)) == best


# Mixing.


def test_targets():
    got = mixing.targets([("b", 100), (None, 10), ("a", 1000)])
    assert [s for s, _, _ in got] == ["a", "b", None] and got[0][2] + got[1][2] + got[2][2] == pytest.approx(1665)
    assert got[1][2] == 200 and got[2][2] == 20 and got[0][2] == pytest.approx(1445)
    assert mixing.targets([]) == [] and mixing.targets([("a", 0)])[0][2] == 0
    order = [s for s, _, _ in mixing.targets([("\U0001F600", 1), ("￿", 1), ("z", 1)])]
    assert order == ["z", "￿", "\U0001F600"]


def test_knapsack_equals_brute_force():
    rng = random.Random(10)
    for _ in range(100):
        sizes = rng.sample(range(1, 12), rng.randint(1, 4))
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, 30)
        sums = {0}
        for s, n in zip(sizes, counts):
            sums = {x + k * s for x in sums for k in range(n + 1)}
        took, total = mixing.knapsack(sizes, counts, budget)
        assert total == max(x for x in sums if x <= budget) == sum(s * k for s, k in zip(sizes, took)) and all(k <= n for k, n in zip(took, counts))


def test_fit_source():
    assert mixing.fit_source(np.array([7, 10]), np.array([1, 1]), 24.9).tolist() == [2, 1]
    assert mixing.fit_source(np.array([5]), np.array([3]), 30).tolist() == [6] and mixing.fit_source(np.array([0]), np.array([3]), 0).tolist() == [0]
    rng = np.random.default_rng(4)
    for _ in range(30):
        sizes, counts = np.unique(rng.integers(1, 900, 60)), None
        counts = rng.integers(1, 30, len(sizes))
        target = float(rng.random() * 2 * (sizes * counts).sum())
        took = mixing.fit_source(sizes, counts, target, fit_words=3000)
        assert (took <= 2 * counts).all() and 0 <= target - (sizes * took).sum() < 2


def test_fit_lengths_large():
    sizes, counts = np.arange(1, 500), np.full(499, 40)
    total = int((sizes * counts).sum())
    for budget in (0, 1, total // 3, total - 5, total, total + 9):
        took = mixing.fit_lengths(sizes, counts, budget, fit_words=2000)
        assert (took <= counts).all() and (sizes * took).sum() == min(budget, total)


@pytest.mark.parametrize("broadcast_rows", [mixing.BROADCAST_ROWS, 0])
def test_mix(spark, docs_of, monkeypatch, broadcast_rows):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(11)
    rows = [(i, words(rng, rng.choice([3, 3, 3, 5, 8, 13]))) for i in range(200)] + [(500, None), (501, ""), (7, "again and again"), (7, "again and again")]
    df = docs_of(rows).selectExpr("doc_id", "text", "nullif(source, 's2') as source", "1 as size", "2 as taken")
    one, two = (mixing.mix(df).toPandas().sort_values(["doc_id", "size", "taken"]).reset_index(drop=True) for _ in range(2))
    assert one.equals(two) and len(one) == len(rows) and (one["taken"] <= 2 * one["size"]).all()
    for _, g in one.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0] and abs(g["taken"].sum() - g["target"].iloc[0]) <= 1
    mixed = mixing.apply_mix(df)
    assert mixed.columns == df.columns
    assert mixed.select(mixing.word_count(mixed["text"]).alias("n")).groupBy().sum("n").first()[0] == one["taken"].sum()
    assert mixing.mix(df.limit(0)).count() == 0


# Chunks.


def test_cuts_resist_insertions():
    rng = random.Random(12)
    x = words(rng, 900).encode()
    y = x[:1500] + b"INSERTED" + x[1500:]
    parts = lambda s: [s[a:b] for a, b in zip([0, *chunk_dedup.cuts(s)[:-1]], chunk_dedup.cuts(s))]
    assert b"".join(parts(y)) == y and len(set(parts(x)) ^ set(parts(y))) <= 6
    assert max(map(len, parts(b"a" * 3000))) <= chunk_dedup.MOST and len(chunk_dedup.cuts(b"")) == 0


def test_gear_equals_definition():
    a = np.frombuffer(words(random.Random(1), 40).encode(), np.uint8)
    h, want = 0, []
    for b in a:
        h = (h << 1) + int(chunk_dedup.GEAR[b]) & 0xFFFFFFFF
        want.append(h & 0xFFFF)
    assert (chunk_dedup.gear(a)[16:] & 0xFFFF).tolist() == want[16:]


def test_repeated_chunks(spark, docs_of):
    rng = random.Random(13)
    passage = words(rng, 60)
    rows = [(i, words(rng, 150) + (" " + passage + " " if i % 4 == 0 else " ") + words(rng, 150)) for i in range(40)]
    rows += [(50, None), (51, ""), (None, "short text")]
    out = {r["doc_id"]: r for r in chunk_dedup.removed_chunks(docs_of(rows, extra=True)).collect()}
    assert len(out) == len(rows)
    for i, t in rows[:40]:
        assert (out[i]["n_removed"] > 0) == (i % 4 == 0 and i > 0) and out[i]["n_bytes"] == len(t.encode())
    cut = {r["doc_id"]: r["text"] for r in chunk_dedup.deduplicate(docs_of(rows)).collect()}
    assert cut[0] == rows[0][1] and all(len(cut[i]) == len(t) - out[i]["n_removed"] for i, t in rows[:40]) and cut[50] is None


# Near-duplicates.


def brute_groups(rows, k, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    group = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = group[a], group[b]
                if x != y:
                    group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    return {i: (len(sets[i]), group[i], group[i] == i) for i in sets}


@pytest.mark.parametrize("k,num,den,block", [(3, 85, 100, superminhash.BLOCK), (3, 85, 100, 500), (5, 80, 100, superminhash.BLOCK)])
def test_near_duplicates(spark, docs_of, monkeypatch, k, num, den, block):
    monkeypatch.setattr(superminhash, "BLOCK", block)
    rng = random.Random(14)
    base = [words(rng, 1) for _ in range(120)]
    rows = [(100 + i, " ".join(w if rng.random() > 0.03 * (i % 4) else words(rng, 1, "xyz") for w in base)) for i in range(60)]
    rows += [(i, words(rng, 40)) for i in range(20)] + [(30, rows[0][1].upper()), (31, None), (32, ""), (33, " \n"), (34, "one two"), (35, "ONE\ttwo"), (36, "one")]
    out = superminhash.near_duplicates(docs_of(rows, extra=True), k, num, den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out} == brute_groups(rows, k, num, den)
    assert superminhash.near_duplicates(docs_of(rows).limit(0), k, num, den).count() == 0


def test_near_duplicates_repeated_and_null_ids(spark, docs_of):
    out = superminhash.near_duplicates(docs_of([(4, "a b c d"), (4, "a b c d"), (None, "a b c d"), (9, "a b c d")])).collect()
    assert sorted(map(tuple, out), key=key) == sorted([(4, 2, 4, True), (4, 2, 4, True), (None, 2, None, None), (9, 2, 4, False)], key=key)
    kept = superminhash.deduplicate(docs_of([(4, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f")]))
    # Rows without id are documents of their groups too, after those with one.
    assert [r["doc_id"] for r in kept.collect()] == [4]


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    error = []
    for share in (0.3, 0.6, 0.85):
        for _ in range(30):
            n = 200
            x = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            m = int(round(2 * n * share / (1 + share)))
            a, b = np.unique(x[:n]), np.unique(np.concatenate([x[: m], x[n : 2 * n - m]]))
            s = superminhash.signatures([a, b], 125)
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            error.append(float((s[0] == s[1]).mean()) - true)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_superminhash_equals_definition():
    rng = np.random.default_rng(3)
    from weft.llm.common import mix64

    for n in (1, 3, 40):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        m = 16
        want = [(1 << 64) - 1] * m
        for e in x:
            perm = list(range(m))
            for j in range(m):
                z = int(mix64(np.array([e], np.uint64) + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))[0])
                k = j + ((z >> 32) * (m - j) >> 32)
                perm[j], perm[k] = perm[k], perm[j]
                want[perm[j]] = min(want[perm[j]], j << 32 | z & 0xFFFFFFFF)
        assert superminhash.signatures([x], m)[0].tolist() == want


def test_chained_documents_are_not_compared(spark, docs_of):
    """Documents of a long chain share buckets with the next ones, but no two of them are candidates unless they may link."""
    rng = random.Random(41)
    stream = words(rng, 6200).split()
    rows = [(i, " ".join(stream[i * 60 : i * 60 + 160])) for i in range(100)] + [(200, " ".join(stream[:158])), (201, " ".join(stream[60:220]))]
    docs = docs_of(rows)
    seen = []
    made = superminhash.candidates
    try:
        superminhash.candidates = lambda *a: seen.append(made(*a)) or seen[-1]
        got = superminhash.near_duplicates(docs).collect()
    finally:
        superminhash.candidates = made
    assert {(r["doc_id"], r["component_id"]) for r in got if not r["kept"]} == {(200, 0), (201, 1)}
    # A third of the 99 neighbouring pairs share a bucket.
    assert seen and all(c.count() <= 4 for c in seen)


@pytest.mark.parametrize("members", [superminhash.MEMBERS, 8])
def test_buckets_of_many_components(spark, docs_of, monkeypatch, members):
    """Groups whose copies differ from each other by about the threshold, in buckets cut into blocks and size classes."""
    monkeypatch.setattr(superminhash, "MEMBERS", members)
    rng = random.Random(43)
    rows = []
    for g in range(3):
        base = words(rng, 150).split()
        for i in range(30):
            w = list(base)
            for _ in range(rng.randint(1, 9)):
                w[rng.randrange(len(w))] = words(rng, 1)
            rows.append((100 * g + i, " ".join(w[: rng.choice([130, 140, 150])])))
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    assert 3 < len(set(root.values())) < len(rows)
    for start in ("stars", "none"):
        if start == "none":  # every link is left to the buckets
            monkeypatch.setattr(superminhash, "_confirm", lambda pairs, *a: pairs.limit(0))
        got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(docs_of(rows)).collect()}
        assert got == root


def test_near_duplicate_rows_with_repeated_and_null_ids(spark):
    rng = random.Random(44)
    a, b, c = words(rng, 80), words(rng, 80), words(rng, 80)
    rows = [(5, a, "x", 1), (5, b, "y", 2), (3, b, "z", 3), (None, a, "w", 4), (None, c, "v", 5), (None, c, "u", 6), (7, c + " tail", "t", 7), (9, None, "s", 8), (9, None, "s", 9), (8, "", "r", 10)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, row string, _group int")
    out = superminhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r["_group"] for r in out.collect()) == [1, 3, 7, 8, 9, 10]
    assert superminhash.deduplicate(docs.limit(0)).count() == 0


def test_knapsack_memory_and_optimum():
    import tracemalloc

    rng = random.Random(12)
    for _ in range(60):
        lengths = rng.sample(range(1, 40), rng.randint(1, 6))
        counts = [rng.randint(0, 5) for _ in lengths]
        budget = rng.randint(0, 150)
        got, total = mixing.knapsack(lengths, counts, budget)
        sums = {0}
        for x, n in zip(lengths, counts):
            sums = {s + k * x for s in sums for k in range(n + 1) if s + k * x <= budget}
        assert total == max(sums) == sum(a * b for a, b in zip(got, lengths)) and all(0 <= a <= n for a, n in zip(got, counts))
    tracemalloc.start()
    mixing.knapsack(list(range(20_000, 0, -1)), [3] * 20_000, mixing.FIT_WORDS)
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
