"""The ten operators and the pipeline against brute force, and on odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import bpe, chroma, components, language, lines, mixing, ngram_join, queries, simhash, spotsigs, suffixes, token_files, toxicity

VOCAB = public_tokenizers.path("byte_bpe_50k.json")
# columns whose names the operators use inside
EXTRA = "id long, key string, rid long, mini long, sigs string, media string, block long, n_tokens string, score string, line string, votes long, __gone string"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    return spark


def documents(spark, rows):
    """(doc_id, text, lang, source, n_chars) with further columns of clashing names."""
    extra = tuple(None for _ in EXTRA.split(","))
    full = [(*r, *(None,) * (4 - len(r)), len(r[1] or ""), *extra) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}")


LONG = " ".join(f"word{i % 97} of the {i * 7 % 13}" for i in range(9000))
ODD = [(1, "", "en", "a"), (2, None, None, None), (3, "x", "en", None), (4, "The cat sat on the mat and the dog.", "en", "a"),
       (5, "The cat sat on the mat and the dog.", "de", "b"), (5, "The cat sat on the mat and the dog.", "de", "b"),
       (6, LONG, "fr", "a"), (None, "no id at all", "en", "a"), (7, "  \n\t ", "en", ""), (8, "é ñ ü 日本 😀" * 20, "es", "c")]


@pytest.fixture(scope="module")
def texts(shared, sf):
    return shared.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


# ---- odd rows: each operator gives every row a defined result ------------------------------------

OPERATORS = {
    "op1": lambda s, d: toxicity.score(d, s.createDataFrame([(4, 1), (1, 0), (6, 0), (None, 1)], "doc_id long, toxic int"), F.lit(True)),
    "op2": lambda s, d: bpe.round_trip_digests(d, VOCAB),
    "op5": lambda s, d: language.predict(d, language.learn(d)),
    "op6": lambda s, d: simhash.near_duplicates(d),
    "op7": lambda s, d: lines.without_repeats(d.select("doc_id", "text", "key", "line", "__gone")),
    "op8": lambda s, d: suffixes.repeat_digests(d),
    "op9": lambda s, d: spotsigs.edited_likeness(d),
    "op10": lambda s, d: token_files.token_counts(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(shared, name):
    got = OPERATORS[name](shared, documents(shared, ODD)).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r[0]) for r in ODD)
    same = [tuple(r) for r in got if r["doc_id"] == 5]
    assert name in ("op9", "op10") or same[0] == same[1]
    assert OPERATORS[name](shared, documents(shared, [])).collect() == []


def test_odd_rows_of_searches_and_mixing(shared):
    docs = documents(shared, ODD)
    media = docs.select("doc_id", F.col("text").cast("binary").alias("media"), F.col("score").alias("sound"))
    got = chroma.search(media, F.col("id").isNotNull()).collect()
    assert Counter(r["doc_id"] for r in got if r["bit_error"] == 0) >= Counter(r[0] for r in ODD if r[0])
    assert chroma.search(media.limit(0), F.lit(True)).collect() == []
    counted = docs.withColumn("n_tokens", mixing.words_in("text"))
    taken = mixing.mix(counted, ["lang", "source"], {}, least_epochs=1, most_epochs=2, share_of_supply=1.0).collect()
    assert sorted(str(r["doc_id"]) for r in taken) == sorted(str(r[0]) for r in ODD)
    assert mixing.mix(counted.limit(0), ["lang", "source"], {}).collect() == []


# ---- toxicity --------------------------------------------------------------------------------------

def test_toxicity_learns_from_allowed_labels_only(shared):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    rows, marks = [], []
    for i in range(900):
        bad = i % 6 == 0
        text = " ".join(rng.choice(words) for _ in range(40)) + (f" {rng.choice(['zorkish', 'blimpy', 'quaxen'])}!" if bad else "")
        rows.append((i, text))
        marks.append((i, int(bad) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not bad)))  # wrong where it must not look
    learning = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    got = toxicity.score(documents(shared, rows), shared.createDataFrame(marks, "doc_id long, toxic int"), learning).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 6 == 0) and 0 <= r["score"] <= 1 for r in got)


def test_labels_without_texts_make_nothing_toxic(shared):
    docs = documents(shared, [(i, f"some text {i}") for i in range(5)])
    labels = shared.createDataFrame([(100 + i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for learning in (F.lit(True), F.lit(False)):
        assert all(r["score"] == 0 and r["predicted"] == 0 for r in toxicity.score(docs, labels, learning).collect())


def test_label_model_discounts_copies_of_a_voter():
    rng = np.random.default_rng(0)
    y = rng.random(20000) < 0.3
    one, copy, other = rng.random(20000) < np.where(y, 0.6, 0.3), None, [rng.random(20000) < np.where(y, 0.9, 0.05) for _ in range(2)]
    copy = one
    votes = one * 1 + copy * 2 + other[0] * 4 + other[1] * 8
    kinds, n = np.unique(votes, return_counts=True)
    label = np.full(len(kinds), -1)
    known, count = np.unique(votes[:2000] * 2 + y[:2000], return_counts=True)
    model = toxicity.LabelModel.fit(np.concatenate((kinds, known // 2)), np.concatenate((label, known % 2)), np.concatenate((n, count)).astype(float), 4)
    assert any({0, 1} <= set(c) for c in model.cliques)
    odds = model.log_odds(np.array([3, 0]))
    true = np.log([0.6 / 0.3, 0.4 / 0.7]) + np.log(0.3 / 0.7) + 2 * np.log(0.1 / 0.95)
    assert np.abs(odds - true).max() < 0.5


# ---- BPE -------------------------------------------------------------------------------------------

def test_bpe_equals_the_library(shared, texts):
    rng = random.Random(1)
    pool = "ab '\n\t\x1c\x85\xa0é½²9_-!.日١<|>sSdlmvret’€́ʰ"
    odd = ["", "<|endoftext|>a<|endoftext|>", "aaaaaaaaa", *("".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500))]
    all_texts = odd + [r["text"] for r in texts]
    library = Tokenizer.from_file(VOCAB)
    got = bpe.Encoder(bpe.Vocabulary(open(VOCAB, "rb").read()))(all_texts)
    for text, ids in zip(all_texts, got, strict=True):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    docs = documents(shared, list(enumerate(odd[:40])))
    tokens = bpe.encode(docs, VOCAB)
    assert {r["doc_id"]: r["text"] for r in bpe.decode(tokens, VOCAB).collect()} == dict(enumerate(odd[:40]))
    digests = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, VOCAB).collect()}
    for i, text in enumerate(odd[:40]):
        ids = library.encode(text, add_special_tokens=False).ids
        assert digests[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert digests[i]["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# ---- mixing ----------------------------------------------------------------------------------------

def test_budgets_give_shortages_to_siblings_first():
    supply = {("a", "en"): 100, ("a", "fr"): 10, ("b", "en"): 1000}
    got = mixing.leaf_budgets(supply, {("a",): 1, ("b",): 1}, 200, 0, 1)
    assert got == {("a", "en"): 90, ("a", "fr"): 10, ("b", "en"): 100}  # what fr lacks goes to en of a
    assert mixing.leaf_budgets(supply, {}, 400, 0, 1) == {("a", "en"): 100, ("a", "fr"): 10, ("b", "en"): 290}
    rng = random.Random(5)
    for _ in range(300):
        n = rng.randint(1, 6)
        most = [rng.randint(0, 50) for _ in range(n)]
        least = [rng.randint(0, m) for m in most]
        weights, budget = [rng.choice([0, 0.5, 1, 3]) for _ in range(n)], rng.randint(0, 200)
        out = mixing.split_budget(budget, weights, least, most)
        assert sum(out) == min(max(budget, sum(least)), sum(most)) and all(a <= x <= b for a, x, b in zip(least, out, most, strict=True))


def test_mixing_takes_the_prefix_of_seeded_epochs(shared, texts):
    docs = documents(shared, [tuple(r) for r in texts]).withColumn("n_tokens", mixing.words_in("text"))
    got = mixing.mix(docs, ["lang", "source"], {("en",): 3.0}, share_of_supply=0.9, most_epochs=2, seed=5, buckets=8).collect()
    n = {r["doc_id"]: len(r["text"].split()) for r in texts}
    leaf = {r["doc_id"]: (r["lang"], r["source"]) for r in texts}
    supply = Counter()
    for d, k in leaf.items():
        supply[k] += n[d]
    budgets = mixing.leaf_budgets(supply, {("en",): 3.0}, round(0.9 * sum(supply.values())), 0, 2)
    taken = defaultdict(list)
    for r in got:
        taken[r["lang"], r["source"]].append(r)
    hashes = {(r["doc_id"], r["epoch"]): r["h"] for r in docs.select("doc_id", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("epoch"))
              .select("doc_id", "epoch", F.xxhash64(F.lit(5), F.col("epoch"), F.col("doc_id").cast("string")).alias("h")).collect()}
    for k, rows in taken.items():
        assert sum(r["take_tokens"] for r in rows) == budgets[k]
        whole, part = divmod(budgets[k], supply[k])
        order = sorted((d for d in leaf if leaf[d] == k), key=lambda d: (hashes[d, whole] >> 40 & 7, hashes[d, whole])) if whole < 2 else []
        want, so_far = [(d, e) for e in range(whole) for d in leaf if leaf[d] == k], 0
        for d in order:
            if so_far < part:
                want.append((d, whole))
            so_far += n[d]
        assert sorted((r["doc_id"], r["epoch"]) for r in rows) == sorted(want)


# ---- chroma ----------------------------------------------------------------------------------------

def test_chroma_finds_shifted_and_changed_recordings(shared):
    rng = np.random.default_rng(4)

    def tune(seed, n=24000):
        notes = np.random.default_rng(seed).integers(0, 36, n // 800)
        t = np.arange(n) / chroma.RATE
        return np.sin(2 * np.pi * 110 * 2 ** (np.repeat(notes, 800) / 12) * t)

    def pcm(x):
        return bytes((np.clip(x, -1, 1) * 100 + 128).astype(np.uint8))

    base = {i: tune(i) for i in range(12)}
    rows = [(i, pcm(x)) for i, x in base.items()]
    rows += [(20, pcm(base[3])), (21, pcm(base[4][1600:])), (22, pcm(base[5] + rng.normal(0, 0.02, 24000)))]
    got = {(r["doc_id"], r["match_id"]): r for r in chroma.search(shared.createDataFrame(rows, "doc_id long, media binary"), F.lit(True), least_frames=50).collect()}
    assert got[20, 3]["copies"] == 2 and got[20, 3]["offset"] == 0
    assert got[4, 21]["offset"] == 1600 // chroma.HOP and got[21, 4]["offset"] == -1600 // chroma.HOP
    prints = dict(zip([i for i, _ in rows], chroma.fingerprint_batch([m for _, m in rows]), strict=True))
    brute = {(a, b) for a, b in itertools.permutations([i for i in prints if i != 20], 2) if best_error(prints[a], prints[b], 50) <= chroma.ERROR}
    assert {k for k in got if k[0] != k[1] and 20 not in k} == brute and brute


def best_error(a, b, least):
    """Least share of differing bits over all offsets."""
    out = 1.0
    for o in range(least - len(b), len(a) - least + 1):
        i, j = max(o, 0), max(-o, 0)
        n = min(len(a) - i, len(b) - j)
        if n >= least:
            out = min(out, float(np.bitwise_count(a[i:i + n] ^ b[j:j + n]).sum()) / (32 * n))
    return out


def meets(a, b):
    """Whether the search would compare two recordings."""
    (x, at), (y, to) = chroma.marks_of(a, True), chroma.marks_of(b, False)
    (near, there), (other, also) = chroma.pairs_around(a, at), chroma.pairs_around(b, to)
    i, j = np.nonzero(x[:, None] == y[None, :])
    both = there[i] & also[j]
    differ = (np.bitwise_count((near[i] ^ other[j]).view(np.uint64)) * both).sum(axis=1)
    real = differ <= chroma.LOCAL_ERROR * 64 * both.sum(axis=1)
    return bool(real.any()) and chroma.plausible(a, b[::chroma.THIN], np.unique(at[i[real]] - to[j[real]]))


def test_chroma_recall_over_all_offsets(texts):
    """Texts as sound, noise and tones, noisy excerpts of them: over nine in ten pairs within the limit are found."""
    rng, near, found = np.random.default_rng(8), 0, 0
    t = np.arange(3000)
    sounds = [r["text"].encode()[:3000] for r in texts if 900 < len(r["text"] or "")][:25]
    sounds += [rng.integers(60, 200, 3000, dtype=np.uint8).tobytes() for _ in range(25)]
    sounds += [(128 + 60 * np.sin(2 * np.pi * rng.uniform(100, 2000) * t / 8000) + rng.normal(0, 9, 3000)).clip(0, 255).astype(np.uint8).tobytes() for _ in range(25)]
    for sound, level in itertools.product(sounds, (0.02, 0.1, 0.2, 0.3)):
        x = np.frombuffer(sound, np.uint8).astype(float)
        noisy = (x + rng.normal(0, level * x.std(), len(x))).round().clip(0, 255).astype(np.uint8).tobytes()
        a, b = chroma.fingerprint_batch([sound, noisy[int(rng.integers(0, 700)):]])
        if best_error(a, b, chroma.LEAST_FRAMES) <= chroma.ERROR:
            near += 1
            found += meets(a, b) and chroma.align(a, b)[2] <= chroma.ERROR
    assert near > 100 and found >= 0.9 * near


def test_chroma_finds_excerpts_and_short_recordings(shared):
    rng = np.random.default_rng(8)
    sounds = {i: rng.integers(0, 256, 16000).astype(np.uint8).tobytes() for i in range(6)}
    sounds[10] = sounds[0][4800:6400]  # a tenth
    sounds[11] = sounds[1][3200:6000]
    for i in range(20, 50):  # short ones, some without any landmark, with a part of theirs
        sounds[i] = rng.integers(0, 256, 900).astype(np.uint8).tobytes()
        sounds[100 + i] = sounds[i][:800]
    sounds[60] = sounds[2][8000:8800]  # short, out of a long one
    got = {(r["doc_id"], r["match_id"]) for r in chroma.search(shared.createDataFrame(list(sounds.items()), "doc_id long, media binary"), F.lit(True)).collect()}
    prints = dict(zip(sounds, chroma.fingerprint_batch(list(sounds.values())), strict=True))
    assert any(not len(chroma.landmarks(p)) for p in prints.values())
    brute = set()
    for a, b in itertools.permutations(prints, 2):
        _, common, error = chroma.align(prints[a], prints[b])
        if common >= chroma.LEAST_FRAMES and error <= chroma.ERROR:
            brute.add((a, b))
    assert {k for k in got if k[0] != k[1]} == brute
    parts = {(0, 10), (1, 11), (2, 60)} | {(i, 100 + i) for i in range(20, 50)}
    assert parts | {(b, a) for a, b in parts} <= brute


def test_chroma_keeps_no_pairs_that_only_share_a_part(shared, monkeypatch):
    """Pairs that share a short part but do not align grow with the square of the rows: they are written nowhere."""
    rng = np.random.default_rng(2)
    part = rng.integers(0, 256, 1200).astype(np.uint8).tobytes()
    noise = lambda n: rng.integers(0, 256, n).astype(np.uint8).tobytes()
    sounds = {i: noise(1600) + part + noise(1600) for i in range(24)}
    sounds[30], sounds[31] = sounds[0], sounds[1][:4000]
    written, keep = [], chroma.materialise
    monkeypatch.setattr(chroma, "materialise", lambda df: written.append(keep(df)) or written[-1])
    media = shared.createDataFrame([*sounds.items(), (None, sounds[2]), (40, None), (3, sounds[3])], "doc_id long, media binary")
    got = sorted(chroma.search(media, F.lit(True)).collect())
    prints = dict(zip(sounds, chroma.fingerprint_batch(list(sounds.values())), strict=True))
    meet = sum(meets(prints[a], prints[b]) or bool(np.intersect1d(chroma.landmarks(prints[a]), chroma.landmarks(prints[b])).size) for a, b in itertools.combinations(range(24), 2))
    assert meet > 200 and {(r[0], r[1]) for r in got if r[0] != r[1]} == {(30, 0), (1, 31), (31, 1)}
    assert max(df.count() for df in written) <= len(sounds) + 3
    monkeypatch.setattr(chroma, "BLOCK_BYTES", 2000)  # some ten blocks
    monkeypatch.setattr(chroma, "JOINED", 7)
    assert sorted(chroma.search(media, F.lit(True)).collect()) == got


# ---- language --------------------------------------------------------------------------------------

def test_ppm_code_lengths_are_those_of_a_dictionary_of_contexts():
    sample, order = [b"abracadabra", b"abcabcaab"], 3
    sizes = np.array([len(x) for x in sample])
    keys = language.grams(np.frombuffer(b"".join(sample), np.uint8), np.cumsum(sizes) - sizes, order)
    tree = language.Tree.of(*np.unique(keys, return_counts=True), order)
    seen = defaultdict(Counter)
    for text in sample:
        padded = bytes(order) + text
        for i in range(order, len(padded)):
            for k in range(order + 1):
                seen[padded[i - k:i]][padded[i]] += 1

    def bits(context, byte):
        cost, gone = 0.0, set()
        for k in range(order, -1, -1):
            counts = {b: n for b, n in seen[context[len(context) - k:]].items() if b not in gone}
            if not seen[context[len(context) - k:]]:
                continue
            total = sum(counts.values()) + len(counts)
            if byte in counts:
                return cost + np.log2(total / counts[byte])
            if counts:
                cost += np.log2(total / len(counts))
            gone |= set(counts)
        return cost + np.log2(256 - len(gone))

    for text in (b"abra", b"zzab", b"cabd", b"abcabraca", b"\x00q"):
        padded = bytes(order) + text
        want = sum(bits(padded[i - order:i], padded[i]) for i in range(order, len(padded)))
        got = tree.bits(language.grams(np.frombuffer(text, np.uint8), np.array([0]), order)).sum()
        assert abs(want - got) < 1e-9


def test_language_of_held_out_rows(shared, texts):
    docs = documents(shared, [tuple(r) for r in texts])
    got = language.predict(docs, language.learn(docs.where("doc_id % 3 > 0"))).where("doc_id % 3 = 0").collect()
    lang = {r["doc_id"]: r["lang"] for r in texts}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in got]) > 0.95
    odd = {r["doc_id"]: r["lang_pred"] for r in language.predict(documents(shared, [(1, "12 !?"), (2, None), (3, "")]), language.learn(docs)).collect()}
    assert odd == {1: "und", 2: "und", 3: "und"}


# ---- SimHash ---------------------------------------------------------------------------------------

def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_simhash_components_are_those_of_all_pairs(shared, texts):
    got = simhash.near_duplicates(documents(shared, [tuple(r) for r in texts] + [(900, ""), (901, None)])).collect()
    for r in got[:60]:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), next((t["text"] for t in texts if t["doc_id"] == r["doc_id"]), ""))) if w]
        runs = [" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in runs]
        assert r["fp"] & (1 << 64) - 1 == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    check_components(got)


def check_components(got):
    fps = defaultdict(list)
    for r in got:
        fps[r["fp"] & (1 << 64) - 1].append(r["doc_id"])
    parent = {x: x for x in fps}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(parent, a)] = find(parent, b)
    least = defaultdict(lambda: 1 << 62)
    for x, ids in fps.items():
        least[find(parent, x)] = min(least[find(parent, x)], *ids)
    assert all(r["component_id"] == least[find(parent, r["fp"] & (1 << 64) - 1)] for r in got)


@pytest.mark.parametrize("block", [2000, 3])
def test_simhash_blocks_at_every_level(shared, block):
    rng = random.Random(9)
    nodes = set()
    for _ in range(30):
        x = rng.getrandbits(64)
        for _ in range(8):
            nodes.add(x)
            x ^= sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 3)))
            x &= (1 << 64) - 1
    fps = sorted(nodes)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    found = components.components(simhash.links(shared.createDataFrame([(x,) for x in signed], "fp long"), block=block), "a", "b").collect()
    root = {r["node"]: r["root"] for r in found}
    parent = {x: x for x in fps}
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 2:
            parent[find(parent, a)] = find(parent, b)
    by_root, by_brute = defaultdict(set), defaultdict(set)
    for x, s in zip(fps, signed, strict=True):
        by_root[root.get(s, s)].add(x)
        by_brute[find(parent, x)].add(x)
    assert sorted(map(sorted, by_root.values())) == sorted(map(sorted, by_brute.values()))


# ---- lines -----------------------------------------------------------------------------------------

def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, a, most):
    b = list(a)
    for _ in range(rng.randint(0, most)):
        kind, i = rng.random(), rng.randint(0, len(b))
        if kind < 0.33 or i == len(b):
            b.insert(i, rng.choice("abcé"))
        elif kind < 0.66:
            b.pop(i)
        else:
            b[i] = rng.choice("abc")
    return "".join(b) or "x"


def test_banded_distance_and_verification(shared):
    rng = random.Random(5)
    rows = [(a := "".join(rng.choice("abé") for _ in range(rng.randint(1, 14))), changed(rng, a, 4)) for _ in range(800)]
    rows += [(a := "".join(rng.choice("abcdef é") for _ in range(rng.randint(20, 60))), changed(rng, a, 4)) for _ in range(800)]
    df = shared.createDataFrame([(a, b, edits_between(a, b)) for a, b in rows], "a string, b string, d int")
    for k in (1, 2, 3):
        assert df.where(F.least(lines.banded_distance(F.col("a"), F.col("b"), k), F.lit(k + 1)) != F.least("d", F.lit(k + 1))).count() == 0
        assert df.where(lines.verified(F.col("a"), F.col("b"), k) != (F.col("d") <= k)).count() == 0


def test_verification_of_very_long_lines(shared):
    rng = random.Random(15)
    rows = []
    for n in (16384, 20000, 32768, 40000, 50000):
        a = "".join(rng.choice("abcdef ") for _ in range(n))
        for places in ((n // 2,), (0,), (n - 1,), (n // 2, n // 2 + 5), (17000 % n, n - 17000), (9, n // 2), (n // 3, n // 2, n - 9)):
            b = list(a)
            for i in places:
                b[i] = "é"
            rows += [(a, "".join(b), len(set(places)) <= 2), ("".join(b), a, len(set(places)) <= 2)]
        rows += [(a, a[:n // 2] + a[n // 2 + 1:], True), (a, a[:n // 2] + "é" + a[n // 2:n - 7] + a[n - 6:], True), (a, a, True)]
    df = shared.createDataFrame(rows, "a string, b string, near boolean")
    assert df.where(lines.verified(F.col("a"), F.col("b"), 2) != F.col("near")).count() == 0


def test_line_links_are_those_of_all_pairs(shared):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(24, 40))).strip().ljust(24, "z") for _ in range(40)]
    all_lines = sorted({x for b in base for x in (b, changed(rng, b, 3), changed(rng, b, 2)) if len(x) >= 24 and x == x.strip()})
    docs = documents(shared, [(i, "\n".join(all_lines[i::5])) for i in range(5)])
    got = lines.line_links(lines.lines_of(docs, "doc_id", "text")).collect()
    key = {tuple(r["key"]): r["line"] for r in lines.lines_of(docs, "doc_id", "text").collect()}
    pairs = {tuple(sorted((key[tuple(r["a"])], key[tuple(r["b"])]))) for r in got}
    assert pairs == {(a, b) for a, b in itertools.combinations(all_lines, 2) if edits_between(a, b) <= 2}


def test_lines_of_one_name_are_linked(shared, monkeypatch):
    """Names may collide: lines under one name are compared with each other."""
    monkeypatch.setattr(lines, "name_of", lambda line, hashed: F.pmod(hashed, F.lit(3)))
    texts = [f"Order {a} was sent to you on day {b} of it" for a, b in itertools.product("0123", "AB!?")]
    found = lines.lines_of(documents(shared, list(enumerate(texts))), "doc_id", "text")
    key = {tuple(r["key"]): r["line"] for r in found.collect()}
    pairs = {tuple(sorted((key[tuple(r["a"])], key[tuple(r["b"])]))) for r in lines.line_links(found).collect()}
    assert pairs == {(a, b) for a, b in itertools.combinations(sorted(texts), 2) if edits_between(a, b) <= 2}


def test_repeated_lines_go_but_copies_stay(shared):
    own = [f"This line number {'abcdefgh'[i]} belongs to one document alone {i * 37}." for i in range(8)]
    common = "A notice that stands under very many of the texts here."
    rows = [(i, f"{own[i]}\n{own[i][::-1]}\n{common}{'!' * (i % 2)}\n\n") for i in range(6)] + [(9, f"{own[0]}\n{common}"), (5, f"{own[5]}\n{own[5][::-1]}\n{common}!\n\n")]
    got = lines.without_repeats(documents(shared, rows).select("doc_id", "text")).collect()
    text = {r["doc_id"]: (r["text"], r["n_repeated"], r["n_removed"]) for r in got}
    assert text[0] == (rows[0][1], 0, 0)
    assert text[1] == (f"{own[1]}\n{own[1][::-1]}\n\n", 1, 1) and text[5][2] == 1
    assert text[9] == (rows[6][1], 2, 0)  # most of it stands elsewhere: a copy, left to other operators


def test_query_and_stage_remove_every_repeated_line(shared, tmp_path):
    import corpus_pipeline as pipeline
    own = [f"This line number {'abcdefgh'[i]} belongs to one document alone {i * 37}." for i in range(4)]
    common = "A notice that stands under very many of the texts here."
    texts = [f"{own[0]}\n{common}", f"{common}\n{own[0]}!\n{own[1][::-1]}", f"{own[2]}\n{common}\n{own[1][::-1]}", f"{own[2]}\n{common}\n{own[1][::-1]}", f"{common}?\nshort"]
    want = [texts[0], own[1][::-1], own[2], "", "short"]
    docs = documents(shared, list(enumerate(texts))).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.QUERIES["op7_lines"](shared, str(tmp_path)).collect()}
    assert [got[i]["kept_sha256"] for i in range(5)] == [hashlib.sha256(t.encode()).hexdigest() for t in want]
    assert [(got[i]["n_repeated"], got[i]["n_removed"]) for i in range(5)] == [(n, n) for n in (0, 2, 2, 3, 1)]
    kept = pipeline.drop_repeated_lines(shared, docs, str(tmp_path)).collect()
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in kept} == {i: (t, len(t)) for i, t in enumerate(want)}


# ---- suffixes --------------------------------------------------------------------------------------

def test_deep_shallow_order_sorts():
    rng = random.Random(2)
    for letters, most in ((b"ab", 40), (b"abc\x00", 30), (b"a", 60)):
        for _ in range(60):
            start = bytes(rng.choice(letters) for _ in range(rng.randint(0, 20)))
            strings = [(start if rng.random() < 0.6 else b"") + bytes(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(rng.randint(0, 40))]
            assert [strings[i] for i in suffixes.deep_shallow_order(strings, 16)] == sorted(strings)
            if strings:
                assert [strings[i] for i in suffixes.blind_trie_order(strings, 0)] == sorted(strings)


@pytest.mark.parametrize("group", [suffixes.GROUP, 2])
def test_repeated_passages_against_all_windows(shared, group):
    rng, length = random.Random(8), 60
    passages = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(50, 150))) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = ["".join(rng.choice("abcdefgé ") for _ in range(rng.randint(0, 120))) for _ in range(3)]
        rows.append((i, parts[0] + (p := rng.choice(passages))[rng.randint(0, 9):] + parts[1] + (rng.choice(passages) if i % 3 else "") + parts[2]))
    rows += [(100, rows[0][1]), (101, "ab" * 90), (102, "x" * 59), (103, "")]
    count = Counter(t.encode()[i:i + length] for _, t in rows for i in range(len(t.encode()) - length + 1))
    spans = suffixes.repeated_spans(documents(shared, rows), length=length, gram=16, group=group).collect()
    got = {r["id"]: {i for s in r["spans"] for i in range(s["low"], s["high"])} for r in spans}
    for d, t in rows:
        data = t.encode()
        assert got.get(d, set()) == {j for i in range(len(data) - length + 1) if count[data[i:i + length]] > 1 for j in range(i, i + length)}


# ---- SpotSigs --------------------------------------------------------------------------------------

def test_edited_likeness(shared, texts):
    rows = [tuple(r) for r in texts]
    got = {r["doc_id"]: r for r in spotsigs.edited_likeness(documents(shared, rows)).collect()}
    order = sorted(rows)
    for i, (d, t, *_) in enumerate(order):
        after, n = order[(i + 1) % len(order)][1], len(t)
        edited = t[:n - n // 4] + after[:n // 4]
        a, b, c = (spotsigs.signatures(x) for x in (t, edited, after))
        r = got[d]
        assert r["n_chars"] == n and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (spotsigs.written(a), spotsigs.written(b))
        for near, x in (("near_edited", b), ("near_next", c)):
            both = len(set(a) & set(x))
            assert abs(r[near] - (both / (len(a) + len(x) - both) if len(a) + len(x) else 1.0)) < 1e-12
    assert np.mean([r["near_edited"] > r["near_next"] for r in got.values()]) > 0.9


def test_near_pairs_are_those_of_all_pairs(shared, texts):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in texts[:60]]
    for i, (_, t) in enumerate(rows[:30]):
        words = t.split(" ")
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = "changed"
        rows.append((1000 + i, " ".join(words)))
    prints = spotsigs.fingerprints(documents(shared, rows))
    members, pairs = spotsigs.near_pairs(prints, 0.8)
    group = {r["doc_id"]: r["class_id"] for r in members.collect()}
    sets = {group[r["doc_id"]]: set(r["sigs"]) for r in prints.collect()}
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want and want


# ---- token files -----------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [1, 3, 1000])
def test_separator_scan_over_blocks(shared, tmp_path, block):
    rng, files = random.Random(4), {}
    for i in range(6):
        data = [rng.choice([9, 9, 1, 2, 3]) for _ in range(rng.randint(0, 40))]
        files[f"f{i}"] = data
        (tmp_path / f"f{i}").write_bytes(np.array(data, "<u2").tobytes())
    got = defaultdict(list)
    for r in token_files.document_lengths(shared, str(tmp_path), 9, block).collect():
        got[r["file"].rsplit("/", 1)[1]].append((r["number"], r["start"], r["n_tokens"], r["closed"]))
    for name, data in files.items():
        want, start = [], 0
        for i, x in enumerate(data):
            if x == 9:
                want.append((len(want), start, i - start, True))
                start = i + 1
        if start < len(data):
            want.append((len(want), start, len(data) - start, False))
        assert sorted(got[name]) == want


def test_token_counts_have_their_ids(shared, texts):
    got = {r["doc_id"]: r["n_tokens"] for r in token_files.token_counts(documents(shared, [tuple(r) for r in texts])).collect()}
    assert got == {r["doc_id"]: len(r["text"].encode().split()) for r in texts}


# ---- pipeline --------------------------------------------------------------------------------------

def test_pipeline_stages(shared, sf, tmp_path):
    import corpus_pipeline as pipeline
    docs = shared.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(shared, docs, sf).write.parquet(str(tmp_path / name))
        before, docs = docs, shared.read.parquet(str(tmp_path / name))
        kept[name] = docs
        if i < len(pipeline.STAGES) - 1:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = shared.read.parquet(f"{sf}/labels.parquet")
    assert kept["toxicity"].join(labels, "doc_id").where("toxic = 0").count() >= 0.97 * labels.join(shared.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("toxic = 0").count()
    ids = [r[0] for r in kept["line_dedup"].select("doc_id").collect()]
    assert sorted(ids) == sorted(r[0] for r in kept["toxicity"].select("doc_id").collect())
    stay = near_duplicates_by_hand([(r["doc_id"], r["text"]) for r in kept["line_dedup"].collect()])
    assert sorted(r[0] for r in kept["simhash"].select("doc_id").collect()) == sorted(stay)
    assert {r[0] for r in kept["mixing"].select("doc_id").collect()} == set(stay)
    assert kept["bpe"].count() == kept["mixing"].count()


def near_duplicates_by_hand(rows):
    """Least id of each component of texts with a Jaccard similarity of 0.8, compared pair by pair."""
    sets = [frozenset(ngram_join.token_set(t, 5).tolist()) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for x in s for j in holders[x])
        for j in range(i) if not s else common:
            if (not s and not sets[j]) or (s and 100 * common[j] >= 80 * (len(s) + len(sets[j]) - common[j])):
                root[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (key is None, key or 0))
    return [None if unknown else key for unknown, key in least.values()]


COPY = "one of many words that stand in a text which is here twice and once more under no id at all"


def test_pipeline_stages_on_odd_rows(shared, sf):
    """Rows are judged one by one: equal and null ids, copies, empty, null and long texts, empty tables."""
    import corpus_pipeline as pipeline
    rows = [(5, "a text that has nothing to do with the other one under this id"), (5, COPY), (5, COPY), (None, COPY), (None, "no id and no copy of any other text here"),
            (7, COPY + " but longer"), (1, ""), (2, None), (3, " \n "), (4, "x"), (6, LONG), (8, LONG + " end")]
    docs = shared.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(shared, docs.limit(0), sf).collect() == []
    ids = lambda df: sorted((str(r["doc_id"]) for r in df.collect()))
    assert ids(pipeline.drop_repeated_lines(shared, docs, sf)) == ids(docs)
    kept = pipeline.drop_near_duplicates(shared, docs, sf)
    assert ids(kept) == ids(docs.where("false")) + sorted(map(str, near_duplicates_by_hand(rows)))
    texts = [r["text"] for r in kept.collect()]
    assert texts.count(COPY) + texts.count(COPY + " but longer") == 1 and "a text that has nothing to do with the other one under this id" in texts
    assert ids(pipeline.mix_sources(shared, docs, sf)) and len(pipeline.encode(shared, docs, sf).collect()) == len(rows)


def test_pipeline_toxicity_by_row(shared, sf, monkeypatch):
    """A toxic row goes though a clean one has its id, also a null one."""
    import corpus_pipeline as pipeline
    docs = shared.createDataFrame([(1, "bad"), (1, "good"), (None, "bad"), (None, "good"), (2, "bad"), (3, "good")], "doc_id long, text string")
    seen = []

    def score(d, labels, learning, id_col):
        seen.append((sorted(r[0] for r in labels.collect()), d.where(learning).count()))
        return d.select(id_col, F.when(F.col("text") == "bad", 1.0).otherwise(0.0).alias("score"), (F.col("text") == "bad").cast("int").alias("predicted"))

    monkeypatch.setattr(toxicity, "score", score)
    got = sorted((str(r["doc_id"]), r["text"]) for r in pipeline.drop_toxic(shared, docs, sf).collect())
    assert got == [("1", "good"), ("3", "good"), ("None", "good")]
    assert seen[0][1] == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in (1, 1, 2, 3)) + 2 * (zlib.crc32(b"") % 4 != 2)


def test_registered_queries():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.QUERIES] == [str(i) for i in range(1, 14)]
