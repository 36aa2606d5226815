"""The operators against brute force, exact round trips and odd rows."""

import hashlib
import math
import random
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docframe.llm import components, fingerprints, hmm, langid, mixing, packing, quality, quality_rules, simhash, tokencache, warc
from docframe.llm.queries import tokenizer_path

ODD = [
    (None, "a null id, and some words beside it", "en", "a"),
    (1, None, "en", "a"),
    (2, "", "en", None),
    (3, " \t\n ", None, "b"),
    (4, "one", "en", "b"),
    (5, "one", "en", "b"),
    (6, "the same row twice over and over", "en", "b"),
    (6, "the same row twice over and over", "en", "b"),
    (7, "x" * 50_000, "en", "a"),
    (8, "many words " * 20_000, "en", "a"),
    (9, "漢字かな交じり文 und Straße <s> <|endoftext|> \x00   é é 😀", "de", "c"),
    (10, "123 456 !!! ***", "en", "c"),
    (-(1 << 62), "a\nb\na\n\nb\n", "en", "c"),
    (1 << 62, "tie one two three four five six", "en", "a"),
]


def docs_of(spark, rows=ODD, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    if extra:
        # names that the operators use for columns of their own
        for name in ("score", "lang_pred", "kept", "component_id", "fingerprint", "fp", "rep", "content", "position", "block", "hit"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark):
    return docs_of(spark, []).where("false")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- fingerprints


def tokens_of(text):
    import re

    pattern = re.compile(r"[฀-໿က-႟ក-៿぀-ヿ㐀-鿿가-힯]|[^\x20\x09-\x0D]{1,16}")
    return [zlib.crc32(t.encode()) for t in pattern.findall(text or "")]


def anchors_of(text):
    t, k = tokens_of(text), fingerprints.K

    def chain(tokens):
        out = 0
        for j, x in enumerate(tokens):
            out ^= x << 16 * j
        return out

    if len(t) <= k:
        return [(0, chain(t))] if t else []
    return [(i, chain(t[i : i + k])) for i in range(len(t) - k + 1) if min(t[i : i + k]) in (t[i], t[i + k - 1])]


def print_of(text):
    out, last = "", 0
    for pos, h in anchors_of(text):
        out, last = out + f"{pos - last:x}{h:016x}", pos
    return out


def alike(a, b):
    first = lambda x: {h: p for p, h in reversed(anchors_of(x))}
    covers = lambda places: len({p + i for p in places for i in range(fingerprints.K)})
    a, b = first(a), first(b)
    if not a and not b:
        return 1.0
    return (covers(a[h] for h in a if h in b) + covers(b[h] for h in b if h in a)) / (covers(a.values()) + covers(b.values()))


def test_fingerprints_match_brute_force(spark):
    random.seed(3)
    rows = [(i, " ".join(random.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(random.randint(0, 60))), "en", "a") for i in range(200)]
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [(r[0] + 100, *r[1:]) for r in rows]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(docs_of(spark, rows)).collect()}
    rows = sorted(rows, key=lambda r: r[0])
    assert len(got) == len(rows)
    for r, nxt in zip(rows, [*rows[1:], rows[0]]):
        a, b = r[1] or "", nxt[1] or ""
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        x = got[r[0]]
        assert x["n_chars"] == len(a) and x["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert x["fingerprint"] == print_of(a) and x["edited_fingerprint"] == print_of(e)
        assert x["near_edited"] == pytest.approx(alike(a, e)) and x["near_next"] == pytest.approx(alike(a, b))
    read = spark.createDataFrame([(print_of(r[1]),) for r in rows if len(r[1] or "") < 2000], "f string").select("f", fingerprints.read_fingerprint(F.col("f")).alias("a"))
    for r in read.collect():
        assert r["f"] == "".join(f"{a['pos'] - (r['a'][i - 1]['pos'] if i else 0):x}{a['hash'] % (1 << 64):016x}" for i, a in enumerate(r["a"]))


def test_likeness_is_near_the_share_of_common_text(spark):
    """The error of likeness against the share of words that two texts have in the same passages."""
    rng = random.Random(31)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    pairs, want = [], []
    for n in [6, 8, 10, 14, 20, 50, 200, 1000] * 6:
        a = [word() for _ in range(n)]
        kept = rng.randint(n // 2, n)
        b = [word() for _ in range(rng.randint(0, 9))] + a[:kept] + [word() for _ in range(n - kept)]
        pairs.append((len(pairs), " ".join(a), " ".join(b)))
        want.append((n, 2 * kept / (len(a) + len(b))))
    place = lambda c: fingerprints.first_places(fingerprints.anchors(F.col(c)))
    df = spark.createDataFrame(pairs, "i int, a string, b string").select("i", place("a").alias("a"), place("b").alias("b"))
    got = {r["i"]: r["near"] for r in df.select("i", fingerprints.likeness(F.col("a"), F.col("b")).alias("near")).collect()}
    errors = {n: [abs(got[i] - w) for i, (m, w) in enumerate(want) if m == n] for n, _ in want}
    assert max(errors[1000]) < 0.02 and max(errors[200]) < 0.06 and max(errors[50]) < 0.15
    # a half of six words or more that two texts share is seen more often than not
    assert sum(x > 0 for i, x in got.items() if want[i][0] >= 8) == sum(n >= 8 for n, _ in want)


def test_next_rows_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_CHARS", 40)
    rows = [(i * i, f"text number {i}", "en", "a") for i in range(300)]
    got = {r["doc_id"]: r["next_text"] for r in fingerprints.with_next(docs_of(spark, rows).select("doc_id", "text"), ["text"]).collect()}
    assert got == {i * i: f"text number {(i + 1) % 300}" for i in range(300)}


def test_fingerprints_of_odd_rows(spark):
    got = fingerprints.fingerprint_edits(docs_of(spark)).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_edits(empty(spark)).collect() == []


def test_anchors_keep_their_place_in_any_context(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(80)]
    a, b = " ".join([word() for _ in range(30)] + passage), " ".join([word() for _ in range(11)] + passage + [word()])
    df = spark.createDataFrame([(a, b)], "a string, b string")
    place = lambda c: fingerprints.first_places(fingerprints.anchors(F.col(c)))
    m = df.select(fingerprints.positional_matches(place("a"), place("b")).alias("m")).first()["m"]
    assert len(m) > 40 and all(x["a"] - x["b"] == 19 for x in m)


# ---- quality rules


def test_rules_match_brute_force(spark):
    import re

    random.seed(5)
    rows = [(i, "".join(random.choice(["ab", "c", " ", "\n", "#", "é", "\t", "ab c ab "]) for _ in range(random.randint(0, 300))), "en", "a") for i in range(150)] + [(r[0] and r[0] + 1000, *r[1:]) for r in ODD]
    got = quality_rules.judge(docs_of(spark, rows), spark.createDataFrame([(i,) for i in range(40)], "doc_id long"))
    found = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got.collect())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    want = Counter()
    for doc, text, *_ in rows:
        text = text or ""
        w = word.findall(text)
        wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen = Counter(wins)
        covered = {i + j for i, x in enumerate(wins) if seen[x] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if word.search(x)]
        want[doc, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)] += 1
    assert found == want


def test_ratio_tells_trusted_text_from_other(spark):
    rng = random.Random(6)
    good = [(i, " ".join(rng.choice(["sun", "moon", "star", "sky", "rain"]) for _ in range(80)), "en", "a") for i in range(40)]
    bad = [(100 + i, " ".join(rng.choice(["zzq", "***", "sun", "!!!!"]) for _ in range(80)), "en", "a") for i in range(40)]
    got = {r["doc_id"]: r["ratio"] for r in quality_rules.judge(docs_of(spark, good + bad), spark.createDataFrame([(i,) for i in range(20)], "doc_id long")).collect()}
    assert min(got[i] for i in range(40)) > max(got[100 + i] for i in range(40))
    assert quality_rules.judge(empty(spark), spark.createDataFrame([], "doc_id long")).collect() == []


# ---- near duplicates


def test_simhash_by_hand():
    import xxhash

    text = "The quick Brown fox jumps"
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in ("the quick brown", "quick brown fox", "brown fox jumps")]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 3)
    assert simhash.simhash(text) % (1 << 64) == want
    assert simhash.simhash(None) == simhash.simhash(" \n") == 0
    assert simhash.simhash("Ä one") % (1 << 64) == xxhash.xxh64_intdigest("Ä one", 42)


def classes(fps):
    """component of every id by comparing all pairs."""
    ids = list(range(len(fps)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in range(i):
            if bin((fps[i] ^ fps[j]) % (1 << 64)).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


@pytest.mark.parametrize("pairwise", [1, 2, 8, 1000])
def test_links_match_all_pairs(spark, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE_BUCKET", pairwise)
    rng = random.Random(7)
    fps = set()
    for _ in range(30):
        at = rng.getrandbits(64)
        for _ in range(12):
            for _ in range(rng.randint(0, 3)):
                at ^= 1 << rng.randrange(64)
            fps.add(at - (1 << 64) if at >> 63 else at)
    # crowds around one point, near in every segment and far in one
    for spread in (range(64), range(26, 64), range(30, 45)):
        at = rng.getrandbits(64)
        for _ in range(80):
            x = at
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.choice(spread)
            fps.add(x - (1 << 64) if x >> 63 else x)
    fps = sorted(fps)
    reps = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    found = {r["id"]: r["component"] for r in components.connected_components(simhash.link_fingerprints(reps)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == classes(fps)


def test_components_of_a_long_path_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (205, 201), (201, 205)]
    found = {r["id"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 201: 201, 205: 201}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_near_duplicates_of_odd_rows(spark):
    got = simhash.near_duplicates(docs_of(spark)).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[1]["fingerprint"] == "0" * 16 and by[1]["component_id"] == by[2]["component_id"] == by[3]["component_id"] == 1
    assert by[5]["component_id"] == 4 and by[6]["component_id"] == 6
    assert simhash.near_duplicates(empty(spark)).collect() == []
    own = docs_of(spark)
    for name in ("_nth", "_kept", "_kept_", "_d", "_s", "_position"):
        own = own.withColumn(name, F.lit("clash"))
    for kept in (simhash.keep_one(own), simhash.keep_one(own, 0.8, 5)):
        ids = [r["doc_id"] for r in kept.collect()]
        assert len(ids) == len(set(ids)) and None in ids and 5 not in ids and 2 not in ids
        assert kept.columns == own.columns
        assert all(r["_nth"] == r["_kept"] == "clash" for r in kept.collect())
    assert simhash.keep_one(empty(spark), 0.8, 5).collect() == []


# ---- language model


def test_forward_is_the_sum_over_all_paths():
    from itertools import product

    rng = np.random.default_rng(1)
    k = 3
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = np.zeros((hmm.SYMBOLS, k))
    emit[:5] = norm(rng.random((k, 5))).T
    model = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), emit)
    sequences = [[0, 3, 2, 1], [4], [2, 2], [1, 0, 4, 3, 2]]
    got = model.sequences(np.concatenate(sequences), np.array(list(map(len, sequences))))
    for s, value in zip(sequences, got):
        total = 0.0
        for path in product(range(k), repeat=len(s)):
            p = model.start[path[0]] * emit[s[0], path[0]]
            for t in range(1, len(s)):
                p *= model.move[path[t - 1], path[t]] * emit[s[t], path[t]]
            total += p
        assert value == pytest.approx(math.log(total))


@pytest.mark.parametrize("stretch,held", [(512, 1 << 20), (1, 3), (2, 4), (3, 100)])
def test_expected_counts_are_those_of_all_paths(monkeypatch, stretch, held):
    from itertools import product

    monkeypatch.setattr(hmm, "STRETCH", stretch)
    monkeypatch.setattr(hmm, "HELD_TOKENS", held)
    rng = np.random.default_rng(2)
    k = 3
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    emit = np.full((hmm.SYMBOLS, k), 1e-9)
    emit[:5] = norm(rng.random((k, 5))).T
    model = hmm.Model(norm(rng.random(k)), norm(rng.random((k, k))), emit)
    sequences = [[0, 3, 2, 1, 4, 4, 0], [4], [2, 2], [1, 0, 4, 3, 2, 1]]
    start, move, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((5, k)), 0.0
    for s in sequences:
        paths = list(product(range(k), repeat=len(s)))
        weights = np.array([model.start[p[0]] * np.prod([emit[x, z] for x, z in zip(s, p)]) * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) for p in paths])
        total += math.log(weights.sum())
        for p, w in zip(paths, weights / weights.sum()):
            start[p[0]] += w
            for a, b in zip(p, p[1:]):
                move[a, b] += w
            for x, z in zip(s, p):
                emits[x, z] += w
    got = model.expected(np.concatenate(sequences), np.array(list(map(len, sequences))))
    assert got[0] == pytest.approx(start, abs=1e-4) and got[1] == pytest.approx(move, abs=1e-4) and got[2][:5] == pytest.approx(emits, abs=1e-4)
    assert got[3] == pytest.approx(total, abs=1e-4)
    # a round of Baum-Welch does not lower the likelihood of its sequences
    better = model.improved(got[0] - 1, got[1] - 1, got[2], np.zeros(hmm.SYMBOLS))
    assert better.expected(np.concatenate(sequences), np.array(list(map(len, sequences))))[3] >= total
    assert all(np.sum(x) == 0 for x in model.expected(np.zeros(0, np.int64), np.zeros(0, np.int64)))


def test_stretches_of_a_long_text_change_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    model = hmm.Model(*[np.full(s, 1 / hmm.STATES) for s in (hmm.STATES, (hmm.STATES, hmm.STATES))], np.full((hmm.SYMBOLS, hmm.STATES), 1 / hmm.SYMBOLS))
    lengths = rng.integers(1, 3000, 30)
    symbols = rng.integers(0, 300, lengths.sum())
    model = model.improved(rng.random(hmm.STATES), rng.random((hmm.STATES, hmm.STATES)) * 9, rng.random((hmm.SYMBOLS, hmm.STATES)) ** 9, np.zeros(hmm.SYMBOLS))
    cut = model.expected(symbols, lengths)
    monkeypatch.setattr(hmm, "STRETCH", 1 << 20)
    whole = model.expected(symbols, lengths)
    for a, b in zip(cut, whole):
        assert a == pytest.approx(b, rel=2e-3, abs=2e-2)
    assert cut[3] == pytest.approx(model.sequences(symbols, lengths).sum(), rel=1e-5)


def test_scores_equal_training_on_all_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 50)
    rng = random.Random(21)
    rows = [(i, " ".join(rng.choice(["Sun moon", "star", "sky w", "rain", f"v{i % 9}"] if i % 2 else ["un deux", "trois", "quatre x", f"v{i % 9}"]) for _ in range(rng.randint(0, 40))), "en", "a") for i in range(80)]
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(docs_of(spark, rows), rounds=3).collect()}
    low = lambda s: s.encode().translate(hmm.LOWER_ASCII).split() + [hmm.END]
    own = [low(x) for i, x, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for d in own for w in d)
    tokens, words = np.zeros(hmm.SYMBOLS), np.zeros(hmm.SYMBOLS)
    for w, n in c.items():
        tokens[hmm.symbol(w)] += n
        words[hmm.symbol(w)] += 1
    share = tokens + words + 1
    background = share / share.sum()
    flat, lengths = np.array([hmm.symbol(w) for d in own for w in d]), np.array(list(map(len, own)))
    start, _, emit, _ = hmm.sorted_apart(background)(flat, lengths)
    stay = np.full((8, 8), 0.1 / 7) + (0.9 - 0.1 / 7) * np.eye(8)
    model, told = hmm.Model(start, stay, emit).improved(start, stay * 100, emit, background), []
    for _ in range(3):
        *counts, likelihood = model.expected(flat, lengths)
        told.append(likelihood / len(flat))
        model = model.improved(*counts, background)
        if len(told) > 1 and told[-1] - told[-2] < hmm.GAIN:
            break
    for i, x, *_ in rows:
        d = low(x)
        own = np.array([hmm.symbol(w) for w in d])
        want = model.sequences(own, np.array([len(d)]))[0] / math.log(10) + sum(math.log10((c[w] + 1) / share[hmm.symbol(w)]) for w in d)
        assert got[i] == pytest.approx(want, abs=2e-2), i


def test_counts_of_words_of_any_size(spark):
    words = [f"w{i}" for i in range(50)]
    counts = {w: [0, 1, (1 << 32) - 1, 1 << 32, 1 << 50][i % 5] for i, w in enumerate(words)}
    blocks = spark.createDataFrame([(b, words[b:][::-1]) for b in range(3)], "block long, words array<string>")
    got = hmm.word_counts(blocks, spark.createDataFrame(list(counts.items()), "word string, c long")).collect()
    assert {r["block"]: r["counts"] for r in got} == {b: [counts[w] for w in words[b:][::-1]] for b in range(3)}


def test_held_out_texts_score_above_the_base(spark, sf):
    rows = hmm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    assert sum(r["score"] > r["base_score"] for r in rows) >= 0.9 * len(rows)
    assert sum(r["score"] for r in rows) > 0.98 * sum(r["base_score"] for r in rows)


def test_base_scores_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(hmm, "BLOCK_TOKENS", 60)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["Sun", "moon", "star", f"w{i}", "Été"]) for _ in range(rng.randint(0, 40))), "en", "a") for i in range(60)] + [(r[0] and r[0] + 1000, *r[1:]) for r in ODD]
    got = hmm.score_documents(docs_of(spark, rows), rounds=1).collect()
    assert len(got) == len(rows)
    low = lambda s: (s or "").encode().translate(hmm.LOWER_ASCII).split() + [hmm.END]
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2
    c = Counter(w for i, x, *_ in rows if not held(i) for w in low(x))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(low(x)), sum(w in c for w in low(x)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in low(x)), 5)) for i, x, *_ in rows)
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.score_documents(empty(spark)).collect() == []


# ---- mixing


def scheduled(blocks, parts):
    """(source, block, phase, slot, release, deadline), one slot after the other."""
    left, done, out, phase = list(blocks), [0] * len(blocks), [], 0
    while any(left):
        active = [i for i, n in enumerate(left) if n]
        whole, began, count = sum(parts[i] for i in active), len(out), dict.fromkeys(active, 0)
        while all(left[i] for i in active):
            now = len(out) - began
            times = {i: (count[i] * whole // parts[i], -(-(count[i] + 1) * whole // parts[i])) for i in active}
            i = min((i for i in active if times[i][0] <= now), key=lambda i: (times[i][1], i))
            out.append((i, done[i], phase, len(out), began + times[i][0], began + times[i][1]))
            count[i] += 1
            done[i] += 1
            left[i] -= 1
        phase += 1
    return out


def test_schedule_deviates_by_less_than_one_block():
    blocks, weights = [400, 90, 300, 5], [0.5, 0.3, 0.19, 0.01]
    parts = mixing.whole_parts(weights, 100)
    plan = scheduled(blocks, parts)
    assert parts == [50, 30, 19, 1] and all(r <= slot < d for _, _, _, slot, r, d in plan)
    count = [0] * 4
    for t, x in enumerate(x for x in plan if x[2] == 0):
        count[x[0]] += 1
        assert all(abs(count[i] - weights[i] * (t + 1)) < 1 for i in range(4))
    found = mixing.schedule(blocks, parts)
    assert [sum(p.took.values()) for p in found] == [sum(x[2] == n for x in plan) for n in range(len(found))]
    for weights in ([1.0, 0.0], [1.0, -1.0], [1.0, math.inf], [1.0, 1e-9]):
        with pytest.raises(ValueError):
            mixing.whole_parts(weights)


@pytest.mark.parametrize("block,precision", [(1, 64), (1, 16_384), (3, 64), (7, 11), (1000, 64)])
def test_mix_equals_the_schedule_by_hand(spark, block, precision):
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(None, "x", "en", None), (500, "", "de", None), (-7, None, None, "s1")]
    got = {(r["doc_id"], r["source"]): tuple(r)[2:] for r in mixing.mix(docs_of(spark, rows), block=block, precision=precision).collect()}
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r[0])
    key = lambda s: "n" if s is None else "s" + s
    order = sorted(by, key=key)
    for ids in by.values():
        ids.sort(key=lambda i: (hashlib.md5(f"5:{'' if i is None else i}".encode()).hexdigest(), i or 0))
    precision = max(precision, 8 * len(order))
    sizes = [len(by[s]) ** 0.5 for s in order]
    sizes = [max(x, sum(sizes) / precision) for x in sizes]
    plan = scheduled([-(-len(by[s]) // block) for s in order], mixing.whole_parts(sizes, precision))
    want, position = {}, 0
    for source, j, phase, slot, release, deadline in plan:
        for i in by[order[source]][j * block : (j + 1) * block]:
            want[i, order[source]] = (j, phase, slot, release, deadline, position)
            position += 1
    assert got == want


def test_mix_places_every_row_once(spark):
    rows = [(i, "x", "en", "hot" if i % 3 else f"s{i % 7}") for i in range(500)] + ODD
    got = mixing.mix(docs_of(spark, rows), block=10).collect()
    assert sorted(r["position"] for r in got) == list(range(len(rows)))
    assert Counter((r["doc_id"], r["source"]) for r in got) == Counter((r[0], r[3]) for r in rows)
    by_slot = {}
    for r in sorted(got, key=lambda r: r["position"]):
        by_slot.setdefault(r["slot"], set()).add((r["source"], r["block"]))
    assert list(by_slot) == sorted(by_slot) and all(len(x) == 1 for x in by_slot.values())
    assert mixing.mix(empty(spark)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark), {"a": 1.0})
    ordered = mixing.in_order(docs_of(spark, rows))
    assert rows_of(ordered) == rows_of(docs_of(spark, rows)) and ordered.columns == docs_of(spark).columns


# ---- language identification


def test_languages_of_held_out_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert got and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)


def test_languages_of_odd_rows(spark):
    got = langid.identify(docs_of(spark)).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == {1, 2, 3, 10}
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    assert langid.identify(empty(spark)).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs_of(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def ngrams(text):
    """As strings: white space, digits and controls are gaps, of which neighbours are one."""
    import re

    t = re.sub(r"[\s\d\x00-\x1f]+", " ", text.lower())
    return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}


def ridge_by_hand(rows, marks):
    """The regression in the landmarks' space, with plain sets and dense matrices."""
    k = lambda a, b: len(ngrams(a) & ngrams(b)) / math.sqrt(len(ngrams(a)) * len(ngrams(b)))
    languages = sorted({lang for _, lang in rows})
    values, vectors = np.linalg.eigh(np.array([[k(a, b) for b in marks] for a in marks]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    phi = lambda x: np.array([k(x, m) for m in marks]) @ root
    x = np.array([phi(t) for t, _ in rows])
    y = np.array([[1.0 if lang == c else -1.0 for c in languages] for _, lang in rows])
    w = np.diag([1 / sum(lang == o for _, o in rows) for _, lang in rows])
    beta = np.linalg.inv(x.T @ w @ x + langid.RIDGE * np.eye(x.shape[1])) @ x.T @ w @ y
    return lambda t: phi(t) @ beta


def test_regression_equals_plain_matrices(monkeypatch):
    monkeypatch.setattr(langid, "LANDMARKS_PER_LANGUAGE", 4)
    rng = random.Random(11)
    letters = {"a": "abcdefg hi", "b": "defgxyz  7", "c": "漢字かな交じり文 地図"}
    make = lambda s, n: "".join(rng.choice(s) for _ in range(n)) + s[0]
    rows = [(make(s, rng.randint(5, 60)), lang) for lang, s in letters.items() for _ in range(9)]
    model = langid.fit(rows)
    assert model.languages == ["a", "b", "c"]
    by_hand = ridge_by_hand(rows, [x for lang in "abc" for x in [t for t, o in rows if o == lang][:4]])
    texts = [make(rng.choice(list(letters.values())), rng.randint(1, 90)) for _ in range(30)]
    got, shares = model.decide(texts)
    known = set().union(*(ngrams(x) for lang in "abc" for x in [t for t, o in rows if o == lang][:4]))
    for t, v, share in zip(texts, got, shares):
        assert v == pytest.approx(by_hand(t), abs=2e-4)
        assert share == pytest.approx(len(ngrams(t) & known) / len(ngrams(t)))


def test_every_character_counts():
    """Two languages of the same thousands of characters, in another order."""
    rng = random.Random(12)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    follow = {lang: {c: rng.sample(signs, 3) for c in signs} for lang in "xy"}

    def make(lang):
        out = [rng.choice(signs)]
        while len(out) < 300:
            out.append(rng.choice(follow[lang][out[-1]]))
        return "".join(out)

    model = langid.fit([(make(lang), lang) for _ in range(60) for lang in "xy"])
    texts = [make(lang) for _ in range(40) for lang in "xy"]
    assert model.predict(texts)[0] == ["x", "y"] * 40
    assert len(langid.grams("".join(signs))) == 3000 + 2999 + 2998


def test_three_hundred_languages(spark):
    rng = random.Random(13)
    syllables = ["".join(p) for p in __import__("itertools").product("bcdfghjklmnpqrstvwxz", "aeiou")]
    own = [rng.sample(syllables, 12) for _ in range(300)]
    make = lambda k: " ".join("".join(rng.choice(own[k]) for _ in range(rng.randint(1, 4))) for _ in range(40))
    rows = [(i, make(i % 300), f"l{i % 300}", "a") for i in range(300 * 12)]
    got = langid.identify(docs_of(spark, rows, extra=False)).where("held_out").collect()
    right = sum(r["lang_pred"] == f"l{r['doc_id'] % 300}" for r in got)
    assert len(got) > 700 and right >= 0.95 * len(got)


def test_training_rows_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(langid, "ROWS_PER_LANGUAGE", 9)
    monkeypatch.setattr(langid, "LONGEST_LEARNED", 40)
    rows = [(None, f"text {i} of nobody", "en", "a") for i in range(50)] + [(1, "the same", "de", "a")] * 50 + [(i, "x" * i, "fr", "a") for i in range(60)]
    got = langid.training_rows(docs_of(spark, rows).repartition(5))
    assert Counter(lang for _, lang in got) == {"en": 9, "de": 9, "fr": 9} and max(len(x) for x, _ in got) <= 40
    assert got == langid.training_rows(docs_of(spark, rows[::-1]).repartition(2))


# ---- quality classifier


def test_quality_of_held_out_rows(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.assess(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert got and sum(r["quality"] == r["predicted"] for r in got) >= 0.9 * len(got)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0), (2, 1), (4, 1), (4, 0), (7, None), (8, 5), (None, 1), (999, 1)], "doc_id long, quality int")
    got = quality.assess(docs_of(spark), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert quality.assess(empty(spark), labels).collect() == []
    assert {r["score"] for r in quality.assess(docs_of(spark), labels.where("false")).collect()} == {0.5}


@pytest.mark.parametrize("held", [7, 1 << 16])
def test_vectors_and_pooling_by_hand(spark, monkeypatch, held):
    monkeypatch.setattr(quality, "HELD_TOKENS", held)
    rng = random.Random(14)
    rows = [(i, " ".join(rng.choice(["sun", "Moon", "star!!", "12", "Été", "a_b"]) for _ in range(rng.randint(0, 30))), "en", "a") for i in range(50)] + ODD
    got = quality.word_vectors(docs_of(spark, rows))
    bucket = lambda t: zlib.crc32(t.encode()) % quality.BUCKETS
    sums = {}
    for _, text, *_ in rows:
        for b in {bucket(t) for t in quality.TOKEN.findall(text or "")}:
            sums[b] = sums.get(b, 0) + quality.index_vector(text).astype(int)
    assert set(np.flatnonzero(got.any(axis=1))) == {b for b, x in sums.items() if np.any(x)}
    for b, x in sums.items():
        assert got[b] == pytest.approx(x / max(np.linalg.norm(x), 1e-9), abs=1e-6)
    for _, text, *_ in rows[:20] + [r for r in ODD if len(r[1] or "") < 1000]:
        v = [got[bucket(t)] for t in quality.TOKEN.findall(text or "")]
        parts = [sum(v, np.zeros(quality.SIZE))] + [sum((a * b for a, b in zip(v, v[lag:])), np.zeros(quality.SIZE)) for lag in quality.LAGS]
        assert quality.pool(text, got, quality.Tokens()) == pytest.approx(np.concatenate(parts) / max(1, len(v)), abs=1e-5)


def test_index_vectors_are_sparse_and_balanced():
    every = np.array([quality.index_vector(f"text {i}") for i in range(2000)])
    assert np.abs(every).sum(axis=1).max() <= quality.NONZERO and abs(every.mean()) < 0.01
    assert (np.abs(every @ every.T - np.diag((every**2).sum(axis=1))).mean()) < 1


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(12, 6)), rng.integers(0, 2, 12).astype(float)
    params = [rng.normal(size=(6, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]

    def loss(p):
        z = np.tanh(x @ p[0] + p[1]) @ p[2] + p[3][0]
        return np.mean(np.log1p(np.exp(-np.where(y > 0, z, -z)))) + quality.DECAY / 2 * ((p[0] ** 2).sum() + (p[2] ** 2).sum())

    for i, g in enumerate(quality.gradients(params, x, y)):
        for at in np.ndindex(g.shape):
            moved = [[q.copy() for q in params] for _ in range(2)]
            moved[0][i][at] += 1e-5
            moved[1][i][at] -= 1e-5
            assert g[at] == pytest.approx((loss(moved[0]) - loss(moved[1])) / 2e-5, abs=1e-7)


def test_repeated_words_are_told_by_pooling(spark):
    """Junk that only repeats words, which the mean of its words does not show."""
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(300)]
    good = [(i, " ".join(rng.choice(words) for _ in range(60)), "en", "a") for i in range(300)]
    bad = [(1000 + i, " ".join(w for w in rng.sample(words, 4) for _ in range(15)), "en", "a") for i in range(100)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 1000)) for r in good + bad], "doc_id long, quality int")
    got = quality.assess(docs_of(spark, good + bad, extra=False), labels).where("held_out").collect()
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in got) >= 0.97 * len(got)


def test_temperature_is_fitted():
    rng = np.random.default_rng(3)
    true = rng.normal(0, 1.5, 4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-true))).astype(float)
    assert quality.fit_temperature(true * 3, y) == pytest.approx(3, rel=0.15)


# ---- packing


def check_packed(rows, docs, path):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    ids = {}
    for doc, text, *_ in docs:
        ids.setdefault(doc, []).append(model.encode(text or "", add_special_tokens=False).ids + [1])
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert pieces.keys() == ids.keys()
    for doc, found in pieces.items():
        copies = ids[doc]
        assert sum(r["length"] for r in found) == sum(map(len, copies))
        for r in found:
            assert r["doc_tokens"] == len(copies[0])
            own = copies[0][r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(own)}I", *own))
        starts = Counter()
        for r in found:
            starts.update(range(r["start"], r["start"] + r["length"]))
        assert set(starts.values()) == {len(copies)} and len(starts) == len(copies[0])
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.LENGTH
    return sequences


def test_packing_is_exact_and_full(spark, sf):
    path = tokenizer_path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    sequences = check_packed(packing.pack_documents(docs, path).collect(), rows, path)
    total = sum(r["length"] for s in sequences.values() for r in s)
    assert total / (len(sequences) * packing.LENGTH) > 0.97


def test_packing_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 2)
    path = tokenizer_path("word_bpe_49k.json")
    check_packed(packing.pack_documents(docs_of(spark).repartition(7), path).collect(), ODD, path)
    assert packing.pack_documents(empty(spark), path).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_packing_knows_which_tokenizers_it_can_take_apart(spark, sf, name):
    path = tokenizer_path(name)
    assert packing.TextIds(path).whole == (name != "word_bpe_49k.json")
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()] + [(r[0] and r[0] + 10**9, *r[1:2]) for r in ODD if r[0] != 7]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check_packed(packing.pack_documents(docs, path).collect(), rows, path)


def test_packing_sees_a_changed_tokenizer(tmp_path):
    import json

    conf = json.load(open(tokenizer_path("word_bpe_49k.json")))
    conf["normalizer"]["normalizers"].pop()
    (tmp_path / "t.json").write_text(json.dumps(conf))
    assert packing.TextIds(str(tmp_path / "t.json")).whole


# ---- WARC


def test_archives_round_trip(spark, tmp_path):
    big = "x" * 1000
    rows = [(1, "http://a/\r\nX: y", "small"), (2, None, None), (3, "http://b", big), (9, "http://c", big), (5, "http://d", big), (5, "http://d", big), (None, "http://e", big), (6, "u", "é" * 500), (7, "u", "é" * 500), (8, "u", "small"), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 99)]
    rows += [(20, "z", "n" * 1000), (20, None, "n" * 1000), (20, "y", "n" * 1000), (None, "u", "n" * 1000), (None, "u", "m" * 1000), (None, "u", "m" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("revisit", F.lit("clash")).repartition(3)
    got = warc.archive_pages(pages, f"file://{tmp_path}/w").collect()
    want, first = Counter(), set()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if p is not None and (h or "") == (html or "")]
        again = len(data) >= 1000 and bool(same) and (page != max(same) or html in first)
        if same and page == max(same):
            first.add(html)
        want[page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None] += 1
    assert Counter(tuple(r) for r in got) == want
    assert warc.archive_pages(pages.where("false")).collect() == []


def test_normaliser_takes_one_member_or_many(tmp_path):
    import gzip
    import json

    payloads = [b"", b"abc", b"\r\n\r\n" * 1000, bytes(range(256)) * 3000]
    records = [warc.record_bytes(i, "u", p, len(p), hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate(payloads)]
    for name, data in (("one", gzip.compress(b"".join(records))), ("many", b"".join(map(gzip.compress, records)))):
        (tmp_path / name).write_bytes(data)
        archive, index, n = warc.normalise_file(f"file://{tmp_path}/{name}", f"file://{tmp_path}/out")
        assert n == len(records)
        whole = open(archive.removeprefix("file://"), "rb").read()
        lines = [json.loads(x) for x in open(index.removeprefix("file://"))]
        assert [gzip.decompress(whole[x["offset"] : x["offset"] + x["length"]]) for x in lines] == records
    (tmp_path / "cut").write_bytes(gzip.compress(b"".join(records)[:-9]))
    with pytest.raises(ValueError):
        warc.normalise_file(f"file://{tmp_path}/cut", f"file://{tmp_path}/out")


def test_every_cut_of_an_archive_raises(tmp_path):
    import gzip
    import zlib as z

    payloads = [b"one", b"two " * 300, b"three"]
    records = [warc.record_bytes(i, "u", p, len(p), hashlib.sha1(p).hexdigest(), None, False) for i, p in enumerate(payloads)]
    # blocks of the stream end between records, so many cuts leave whole records
    machine = z.compressobj(6, wbits=31)
    data = b"".join(machine.compress(r) + machine.flush(z.Z_FULL_FLUSH) for r in records) + machine.flush()
    at = tmp_path / "a"
    for n in range(len(data)):
        at.write_bytes(data[:n])
        with pytest.raises(ValueError):
            warc.normalise_file(f"file://{at}", f"file://{tmp_path}/out")
    for padded in (data + b"\0" * 700, data + b"\0\0" + gzip.compress(records[0]) + b"\0"):
        at.write_bytes(padded)
        assert warc.normalise_file(f"file://{at}", f"file://{tmp_path}/out")[2] in (3, 4)
    at.write_bytes(data + b"junk")
    with pytest.raises(ValueError):
        warc.normalise_file(f"file://{at}", f"file://{tmp_path}/out")
    assert gzip.decompress(data) == b"".join(records)


def test_inflating_holds_a_block(tmp_path):
    import gzip
    import io

    out = list(warc.inflate(io.BytesIO(gzip.compress(b"\0" * (40 << 20)))))
    assert sum(map(len, out)) == 40 << 20 and max(map(len, out)) <= warc.BLOCK


# ---- token counts


def test_counts_equal_the_library(spark):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = tokencache.count_tokens(docs_of(spark), path).collect()
    want = Counter((i, len((x or "").encode()), len(model.encode(x or "")), len(model.encode(x or "")) > 4096) for i, x, *_ in ODD)
    assert Counter(tuple(r) for r in got) == want
    rng = random.Random(9)
    own = tokencache.PieceCounter(path)
    for _ in range(5000):
        s = "".join(rng.choice(["a", " ", "  ", "\n", "é", "the", "▁", "\0", "<s>", "😀", " ", "\t"]) for _ in range(rng.randint(0, 12)))
        assert own.count(s) == len(model.encode(s)), repr(s)
    assert tokencache.count_tokens(empty(spark), path).collect() == []


def test_cache_encodes_only_what_it_lacks(spark, tmp_path, monkeypatch):
    path, cache = tokenizer_path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    first = rows_of(tokencache.count_tokens(docs_of(spark), path, cache))
    stored = spark.read.parquet(cache).count()
    assert stored == len({r[1] or "" for r in ODD})
    asked = []
    real = tokencache.encode_counts
    monkeypatch.setattr(tokencache, "encode_counts", lambda df, p: (asked.append(df.count()), real(df, p))[1])
    assert rows_of(tokencache.count_tokens(docs_of(spark), path, cache)) == first
    more = docs_of(spark, [*ODD, (77, "something new", "en", "a"), (78, "something new", "en", "a")])
    tokencache.count_tokens(more, path, cache).collect()
    assert asked == [0, 1] and spark.read.parquet(cache).count() == stored + 1


def test_hot_keys_are_looked_up_whole(spark, monkeypatch):
    from docframe.llm import common

    monkeypatch.setattr(common, "HOT", 5)
    rows = spark.createDataFrame([("hot" if i % 2 else f"k{i}", None if i % 7 == 0 else i, i) for i in range(200)] + [(None, 1, 1000)], "a string, b long, n long")
    lookup = rows.select("a").distinct().where("a is null or a <> 'k4'").withColumn("v", F.length("a"))
    for how in ("inner", "left"):
        assert rows_of(common.join_lookup(rows, lookup, ["a"], how)) == rows_of(rows.join(lookup, ["a"], how))


# ---- pipeline


def test_pipeline_keeps_clean_documents_once(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen.append(stage(spark, seen[-1], sf))
        assert seen[-1].columns == docs.columns, name
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in seen]
    good = {i for i, q in labels.items() if q == 1}
    assert len(good & ids[2]) >= 0.9 * len(good) and len({i for i, q in labels.items() if q == 0} & ids[2]) <= 2
    assert ids[3] == ids[4] and ids[3] <= ids[2]
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert packed == ids[4]


def test_pipeline_stages_take_odd_rows(spark, sf):
    import corpus_pipeline

    for docs in (docs_of(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).collect()


#: Packs a batch of new words as a worker does, and tells how much its memory grew at most, in MB.
PACKED = """
import random, resource, sys
import pyarrow as pa
from docframe.llm import packing
most = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
memory, rng = packing.TextIds(sys.argv[1]), random.Random(4)
letters = "abcdefghijklmnopqrstuvwxyz"
texts = pa.array([" ".join("".join(rng.choices(letters, k=7)) for _ in range(250)) for _ in range(4000)])
before = most()
ids = [x for _, some in packing.chunks(texts) for x in memory.documents(some)]
print(most() - before, len(ids), sum(map(len, ids)))
"""


def test_packing_new_words_takes_little_memory():
    import subprocess
    import sys

    found = subprocess.run([sys.executable, "-c", PACKED, tokenizer_path("word_bpe_49k.json")], capture_output=True, text=True, timeout=300, check=True)
    grown, texts, size = found.stdout.split()
    # the ids alone are about 4 bytes a letter
    assert texts == "4000" and int(size) > 4_000_000 and float(grown) - int(size) / 2**20 < 350


def test_buckets_with_rings_are_taken_a_few_bytes_at_a_time():
    import pyarrow as pa

    from docframe.llm import ring

    key = np.sort(np.arange(60_000, dtype=np.int32) % 700)
    rows = pa.table({"key": key, "rings": pa.array([bytes(512)] * len(key), pa.binary())})
    tables = list(ring._buckets(iter(rows.to_batches(max_chunksize=10_000))))
    assert all(x.nbytes < 2 * ring.HELD_BYTES for x in tables)
    keys = [x.column("key").to_numpy() for x in tables]
    assert np.array_equal(np.concatenate(keys), key) and len(set(np.concatenate([np.unique(x) for x in keys]))) == sum(len(np.unique(x)) for x in keys) == 700
    assert not list(ring._buckets(iter(rows.slice(0, 0).to_batches())))
