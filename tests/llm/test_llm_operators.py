"""Each operator: its method on small cases, defined results for odd input, and brute force where SQL can't express it."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from pitchlake.llm import (
    chat_format,
    exact_dedup,
    license_scan,
    mixing,
    near_dedup,
    nn_descent,
    quality_lm,
    sentencepiece_codec,
    shingles,
    token_count,
    warc,
)

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", None, "a", "don't 'll x'rest   \n\n end ", "<|endoftext|>x<|im_start|>", "é中😀\x00▁  ", "word " * 3000, "x" * 40_000, "a  b\t\tc"]


def odd_docs(spark, extra=()):
    """Nulls in every column, empty and long texts, repeated rows, and columns named like the operators' own."""
    texts = [*ODD, *extra]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "null id", None, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumn("id", F.lit("clash")).withColumn("fp", F.lit(1)).withColumn("size", F.lit(2)).withColumn("node", F.lit(None).cast("string"))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def words(n, seed):
    rng = random.Random(seed)
    return [rng.choice("abcdefghijklmnop") + str(rng.randrange(500)) for _ in range(n)]


# -- exact dedup -------------------------------------------------------------------------------------------------------


def test_fingerprints_compose():
    rng = random.Random(1)
    data = "".join(chr(rng.randrange(32, 0x3000)) for _ in range(150_000))
    raw = data.encode()
    whole = exact_dedup.fingerprint(data)
    parts = [raw[i : i + 50_000] for i in range(0, len(raw), 50_000)]
    maps = [(*exact_dedup.chunk_hash(p), len(p)) for p in parts]
    for order in ("left", "right"):
        out = maps[0] if order == "left" else maps[-1]
        for m in maps[1:] if order == "left" else maps[-2::-1]:
            out = exact_dedup.compose(out, m) if order == "left" else exact_dedup.compose(m, out)
        assert out == whole
    direct = sum(b * pow(exact_dedup.BASES[0], i, exact_dedup.P) for i, b in enumerate(raw[:5000])) % exact_dedup.P
    assert exact_dedup.fingerprint(raw[:5000].decode(errors="ignore"))[2] <= 5000
    assert exact_dedup.chunk_hash(raw[:5000])[0] == direct


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    key = lambda i: -math.inf if i is None else i
    return sorted(
        (str(i), str(max(ids, key=key)), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for i in ids
    )


def test_exact_classes_on_odd_rows(spark):
    df = odd_docs(spark, extra=["a", "x" * 40_000])
    out = exact_dedup.classes(df).collect()
    got = sorted((str(r["id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in out)
    assert got == brute_exact([(r["doc_id"], r["text"]) for r in df.collect()])
    assert sum(r["kept"] for r in out) == len({r["text_sha256"] for r in out})
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns and kept.count() == len({r["text_sha256"] for r in out})
    assert exact_dedup.classes(df.limit(0)).count() == 0


def test_colliding_fingerprints_are_split(spark, monkeypatch):
    """A fingerprint that sees only lengths: comparison must still tell the texts apart."""
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "bb"), (4, "cc"), (5, "aa")], "doc_id long, text string")
    weak = df.select(F.struct(*df.columns).alias("row"), F.col("doc_id").alias("id"), "text").withColumn(
        "fp", F.struct(F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("h2"), F.length("text").cast("long").alias("n_bytes"))
    )
    monkeypatch.setattr(exact_dedup, "_hashed", lambda *_: weak)
    got = {r["id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.classes(df).collect()}
    assert got == {1: (5, 2, False), 5: (5, 2, True), 2: (3, 2, False), 3: (3, 2, True), 4: (4, 1, True)}


# -- mixing ------------------------------------------------------------------------------------------------------------


def test_pivotal_rounding_keeps_mass_and_expectation():
    sizes = [random.Random(3).randrange(1, 400) for _ in range(60)]
    totals = np.zeros(60)
    for seed in range(600):
        out, held, p = mixing._settle([(s, 0.3) for s in sizes], random.Random(seed))
        taken = sum(s * o for s, o in zip(sizes, out)) + (sizes[held] * p if held is not None else 0)
        assert taken == pytest.approx(0.3 * sum(sizes))
        totals += out
        if held is not None:
            totals[held] += p
    assert np.abs(totals / 600 - 0.3).max() < 0.12


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    fixed, budget = {}, 1.5 * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in fixed]
        left = budget - sum(fixed.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_} if open_ else {}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def test_mix_meets_targets_and_reruns_agree(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng.randrange(0, 60), i)), "en", rng.choice(["a", "b", "é", "z", None, "a", "a"]), 0) for i in range(900)]
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    want = brute_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 60
    mixed = mixing.take_mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r["copies"] for r in out)


def test_mix_of_odd_rows(spark):
    df = odd_docs(spark)
    assert mixing.mix(df).count() == df.count()
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.take_mix(df.limit(0)).count() == 0


# -- chat --------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_turn_order(spark):
    evil = "a\\<|im_end|>\\\\<\\|<|im_start|>user\n<|"
    rows = [
        (1, 0, "system", evil), (1, 1, "user", "q"), (1, 2, "assistant", evil), (2, 0, "assistant", "no"), (3, 0, "user\nx<|", None),
        (None, None, None, None), (4, 1, "user", "b"), (4, 0, "user", "a"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in out.select("*", chat_format.read_turns(F.col("formatted")).alias("back"), chat_format.loss_text(F.col("segments")).alias("loss")).collect()}
    back = {k: [(t["role"], t["text"]) for t in r["back"]] for k, r in got.items()}
    assert back[1] == [("system", evil), ("user", "q"), ("assistant", evil)] and got[1]["loss"] == evil
    assert back[3] == [("user\nx<|", "")] and back[4] == [("user", "a"), ("user", "b")] and back[None] == [("", "")]
    assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: False}
    assert chat_format.format_conversations(df.limit(0)).count() == 0


# -- tokens ------------------------------------------------------------------------------------------------------------


def random_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b", "'", "s", "re", "'ll", " ", "  ", "\n", "\t", "é", "中", "1", "2", ".", "%%", "😀", " ", "the", "ing", "<|endoftext|>", "_", "　", "▁", "x" * 40]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 50))) for _ in range(n)]


def test_counts_equal_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, library = token_count.load(path), Tokenizer.from_file(path)
    texts = [t or "" for t in ODD] + random_texts(3000, 1)
    for text, enc in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert machine.count(text) == len(enc.ids), text[:80]
        step = random.Random(len(text)).randrange(1, 9) if len(text) < 1000 else 5000
        maps = [token_count.chunk_map(machine, text[i : i + step]) for i in range(0, max(1, len(text)), step)]
        assert token_count.total(machine, token_count.scan(machine, maps)) == len(enc.ids)


def test_count_operator_on_odd_rows(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    df = odd_docs(spark, extra=[" ".join(words(30_000, 1)), "y" * 33_000 + " " + "z" * 70_000])
    want = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
    got = token_count.count_tokens(df).collect()
    assert sorted((str(r["id"]), r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 512) for r in got)
    assert token_count.count_tokens(df.limit(0)).count() == 0


def test_sentencepiece_equals_the_library_with_spans():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = sentencepiece_codec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t or "" for t in ODD] + random_texts(2000, 2)
    offsets, ids, begins, ends, decoded = codec.encode_batch(texts)
    for i, text in enumerate(texts):
        own = slice(offsets[i], offsets[i + 1])
        want = library.encode(text) + [2]
        assert ids[own].tolist() == want and decoded[i] == library.decode(want) == codec.decode(want)
        spans = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins[own][:-1].tolist(), ends[own][:-1].tolist())) == spans


def test_character_map_takes_the_longest_prefix():
    """A hand-made double array: keys "a" -> "x" and "ab" -> "yz"."""
    units = [0] * 1024

    def unit(offset, label, leaf):
        return (offset << 10) | (256 if leaf else 0) | label

    units[0] = unit(256, 0, False)
    a = 256 ^ ord("a")
    units[a] = unit(512 ^ a, ord("a"), True)
    units[512] = 0 | 1 << 31
    b = 512 ^ ord("b")
    units[b] = unit(768 ^ b, ord("b"), True)
    units[768] = 2 | 1 << 31
    blob = (4096).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"x\0yz\0"
    table = sentencepiece_codec.CharMap(blob)
    assert table.longest(b"abc", 0) == (2, b"yz")
    assert table.longest(b"ac", 0) == (1, b"x")
    assert table.longest(b"ba", 0) == (0, b"")
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    codec.charmap = table
    text, places = codec.normalize("c ab é")
    assert text == "▁c▁yz▁é" and places.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 4, 4, 4, 5, 5, 7]


def test_sentencepiece_operator_on_odd_rows(spark, monkeypatch):
    """Long texts with and without white space, repeats, nulls: the library's ids and decoded texts, row by row."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    long = [(900, "".join(random.Random(5).choices("aétöx9", k=40_000))), (901, "  ".join(words(9000, 4)) + " "), (902, " " * 3000), (903, "a b")]
    df = odd_docs(spark).select("doc_id", "text")
    df = df.union(spark.createDataFrame([*long, *long], df.schema))
    monkeypatch.setattr(sentencepiece_codec, "STRETCH", 1000)
    codec = sentencepiece_codec.Codec(public_tokenizers.path("piece_bpe_32k.model"))
    for text in [t or "" for _, t in df.collect()]:
        offsets, ids, begins, ends, decoded = codec.encode_texts([text, "x"])
        expected = [*library.encode(text), library.eos_id()]
        assert ids[: offsets[1]].tolist() == expected and decoded[0] == library.decode(library.encode(text))
        one = codec.encode_batch([text])
        assert all((a[: offsets[1]] == b).all() for a, b in zip((ids, begins, ends), one[1:4]))
    got = sentencepiece_codec.digests(sentencepiece_codec.encode_documents(df)).collect()

    def expected_row(n, text):
        ids = [*library.encode(text or ""), library.eos_id()]
        return n, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids))

    assert collections.Counter(map(tuple, got)) == collections.Counter(expected_row(*r) for r in df.collect())
    assert sentencepiece_codec.encode_documents(df.limit(0)).count() == 0


def test_token_states_are_dropped_inside_a_text(monkeypatch):
    """Random letters without white space: the count stays the library's, and the states stay few."""
    import tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(path)
    monkeypatch.setattr(token_count, "MAX_STATES", 300)
    monkeypatch.setattr(token_count, "STRIDE", 50)
    monkeypatch.setattr(token_count, "_LOADED", {})
    machine = token_count.load(path)
    rng = random.Random(9)
    for text in ("".join(rng.choices("abcdefghij'é 7", k=5000)), "".join(rng.choices("abcxyz", k=5000)), "it's we'll " * 400):
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(machine.states) < 1000


# -- near duplicates ---------------------------------------------------------------------------------------------------


def test_samples_agree_as_often_as_sets_are_similar():
    base = words(400, 1)
    other = base[:350] + words(60, 2)
    sets = []
    for w in (base, other + other[:80]):
        s, tf = shingles.shingles(shingles.words([" ".join(w)])[0])
        sets.append((s, tf * 2.0))
    out = shingles.Sampler(4000)(sets)
    assert (out[0] == out[1]).mean() == pytest.approx(shingles.similarity(*sets), abs=0.03)


def brute_near(rows):
    feats = [shingles.shingles(h) for h in shingles.words([t for _, t in rows])]
    floor = near_dedup.FLOOR * len(rows)
    load = collections.Counter(b for f in feats for b in shingles.bucket_of(f[0]).tolist())
    counted = collections.defaultdict(set)  # shingle -> documents, those made up mostly of frequent shingles by their first
    for nth, f in enumerate(feats):
        frequent = [x for x, b in zip(f[0].tolist(), shingles.bucket_of(f[0]).tolist()) if load[b] > floor]
        for x in frequent:
            counted[x].add(("like", min(frequent)) if 2 * len(frequent) >= len(f[0]) else ("own", nth))
    df = {x: len(c) for x, c in counted.items() if len(c) > floor}
    w = shingles.Weights(len(rows), near_dedup.FLOOR, np.array(list(df), np.uint64), np.array(list(df.values()), float))
    sets = [(s, w.of(s, tf)) for s, tf in feats]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i][1] == rows[j][1]
            if label[i] != label[j] and (same or shingles.similarity(sets[i], sets[j]) >= near_dedup.SIMILAR):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = collections.defaultdict(set)
    for (i, _), x in zip(rows, label):
        groups[x].add(i)
    return {frozenset(g) for g in groups.values()}


def test_near_classes_equal_brute_force(spark):
    rng = random.Random(8)
    rows, n = [], 0
    for g in range(12):
        base = words(120, g)
        for _ in range(rng.choice([1, 2, 5, 40])):
            w = base[:]
            for _ in range(rng.choice([0, 1, 2, 4])):
                w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
            rows.append((n, " ".join(w)))
            n += 1
    rows += [(n, ""), (n + 1, ""), (n + 2, "?!"), (n + 3, "one two"), (n + 4, "One, TWO."), (n + 5, "one two three")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("label", F.lit(2))
    out = near_dedup.classes(df).collect()
    got = collections.defaultdict(set)
    for r in out:
        got[r["class_id"]].add(r["id"])
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in brute_near(rows)} - {frozenset({n + 3}), frozenset({n + 4})} | {frozenset({n + 3, n + 4})}
    assert all(k == min(g) for k, g in got.items())
    kept = near_dedup.drop_near_copies(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(got)


def test_prefixes_lose_no_link(spark, monkeypatch):
    """Without hub rounds everything is left to the prefixes, here in blocks of three nodes."""
    base = words(100, 99)
    rows = []
    for i in range(30):
        w = base[:]
        for j in range(i % 4):
            w[(i * 3 + 31 * j) % 100] = f"edit{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    weights = spark.sparkContext.broadcast(near_dedup.document_frequencies(df))
    texts = df.select(F.encode(F.col("doc_id").cast("string"), "UTF-8").alias("node"), "text")
    nodes = texts.select("node", F.col("node").alias("label"))
    found = near_dedup._linked_by_prefix(nodes, nodes.limit(0), texts, weights).collect()
    feats = [(s, weights.value.of(s, tf)) for s, tf in map(shingles.shingles, shingles.words([t for _, t in rows]))]
    label = list(range(30))
    for i in range(30):
        for j in range(i):
            if shingles.similarity(feats[i], feats[j]) >= near_dedup.SIMILAR:
                label = [label[j] if x == label[i] else x for x in label]
    assert 1 < len(set(label)) < 30
    got = {int(r["node"]): int(r["label"]) for r in found}
    same = {(i, j) for i in range(30) for j in range(i) if label[i] == label[j]}
    assert {(i, j) for i in range(30) for j in range(i) if got.get(i, -i) == got.get(j, -j)} == same


def test_large_group_of_near_copies_with_two_edits_in_a_hundred_words(spark):
    """A third of all rows: two edits in a hundred words leave 0.81 of the shingles, and the group does not lose weight by its size."""
    base, rng = words(100, 7), random.Random(3)
    rows = []
    for i in range(120):
        w = base[:]
        if i:
            for j in rng.sample(range(20), 2):
                w[5 * j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join(words(100, 1000 + i))) for i in range(240)]
    out = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in out if r["id"] < 120} == {0}
    assert all(r["class_id"] == r["id"] for r in out if r["id"] >= 200)


def test_near_on_odd_and_empty_tables(spark):
    df = odd_docs(spark)
    out = near_dedup.classes(df).collect()
    assert len(out) == df.count()
    texts = {(r["doc_id"], r["text"] or "") for r in df.collect()}
    same = collections.defaultdict(set)
    for n, t in texts:
        same[t].add(n)
    for r in out:  # rows of equal texts are in one class, whose id is the smallest
        group = next(g for g in same.values() if r["id"] in g)
        assert r["class_id"] is None or r["class_id"] <= min((x for x in group if x is not None), default=r["class_id"])
    assert near_dedup.classes(df.limit(0)).count() == 0


# -- quality -----------------------------------------------------------------------------------------------------------


def brute_model(texts):
    """Interpolated modified Kneser-Ney over bigrams, in dictionaries: text -> its negative log probability."""
    hashes = quality_lm.Hashes()
    grams = collections.Counter(g for t in texts for x in [quality_lm.numbers(hashes, t)] for g in zip(x, x[1:]))
    before = collections.Counter(w for _, w in grams)
    n = [sum(v == k for v in grams.values()) for k in range(5)]
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    raw = [1 - 2 * y * n[2] / n[1] if n[1] else 0.5, 2 - 3 * y * n[3] / n[2] if n[2] else 1.0, 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
    d = [min(max(x, 0.1), k - 0.1 if k > 1 else 0.9) for k, x in enumerate(raw, 1)]
    seen, own = collections.Counter(), collections.Counter()
    for (b, _), v in grams.items():
        seen[b] += v
        own[b] += v - d[min(v, 3) - 1]

    def p(b, w):
        low = (max(before[w] - 0.5, 0) + 0.5 * len(before) / (len(before) + 1)) / len(grams)
        if not seen[b]:
            return low
        c = grams[b, w]
        return (c - d[min(c, 3) - 1] if c else 0) / seen[b] + (1 - own[b] / seen[b]) * low

    def cost(text):
        x = quality_lm.numbers(hashes, text)
        return -sum(math.log(p(b, w)) for b, w in zip(x, x[1:]))

    return cost


def test_language_model_equals_brute_force(spark, monkeypatch):
    """Trained on some documents of small chunks, over several shards, against counts in dictionaries."""
    train = [" ".join(words(40, i)) + ". " + "the cat sat on the mat. " * (i % 4) for i in range(40)]
    other = ["the mat sat. THE 12 !!", "", "the the the", "nothing of this is known", "a" * 5000]
    rows = [(i, "en", t, i) for i, t in enumerate(train + other)]
    monkeypatch.setattr(quality_lm, "CHUNK", 300)
    docs = spark.createDataFrame(rows, "id long, lang string, text string, text_key long")
    chunks = quality_lm.durable(quality_lm.encode(docs))
    assert chunks.count() > 5
    trusted = F.transform(F.filter(F.arrays_zip("ids", F.sequence(F.lit(0), F.size("ids") - 1).alias("place")), lambda x: x["ids"] < 40), lambda x: x["place"])
    model = quality_lm.train(chunks.withColumn("trusted", trusted), 7)
    cost = brute_model(train)
    got = {r["id"]: (r["n_tokens"], r["nll"]) for r in quality_lm.score(chunks, model).collect()}
    assert len(got) == len(rows)
    for i, _, text, _ in rows:
        assert got[i] == (len(quality_lm.numbers(quality_lm.Hashes(), text)) - 1, pytest.approx(cost(text), rel=1e-9))


def test_tokens_by_arrays_are_those_of_the_pattern(monkeypatch):
    """The same tokens are equal and different ones differ, over odd characters, long words and texts cut at white space."""
    rng = random.Random(4)
    alphabet = [*"ab_1 \n\t.,-", "é", "ß", "\u0301", "中", "\u2028", "\x1c", "\x00", "²", "😀", "\ud800", "\U0001d7d8"]
    texts = ["".join(rng.choices(alphabet, k=rng.choice([0, 1, 5, 80, 400]))) for _ in range(300)]
    texts += ["the the, the THE", "x" * 64 + " " + "x" * 65 + " " + "x" * 65 + "!", "a" * 5000 + "b " + "b" + "a" * 5000, "go go " * 300]
    monkeypatch.setattr(quality_lm, "PIECE", 100)
    hashes, seen = quality_lm.Hashes(), {}
    got = list(quality_lm.numbered_tokens(hashes, texts))
    assert len(got) == len(texts)
    for text, tokens in zip(texts, got):
        want = quality_lm.numbers(hashes, text)
        assert len(want) == len(tokens)
        assert all(seen.setdefault(a, b) == b for a, b in zip(want, tokens.tolist()))
    assert len(set(seen.values())) == len(seen) and all(seen[k] == k for k in range(3))


def test_quality_sends_no_chunk_through_a_shuffle(spark):
    """Chunks are grouped where they were written, and a bigram is sent once: counted and asked for in one exchange."""
    rows = [(i, "en", " ".join(words(60, i % 50)), i) for i in range(200)]
    docs = spark.createDataFrame(rows, "id long, lang string, text string, text_key long")
    chunks = quality_lm.bucketed(quality_lm.encode(docs), "chunk")
    model = quality_lm.train(chunks.withColumn("trusted", F.array(F.lit(0))), 5)
    plan = quality_lm.score(chunks, model)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(chunk") == 1 and "Bucketed: true" in plan


def test_packed_arrays_come_back():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 48, 1000).astype(np.uint64))
    for n in (0, 1, 1000):
        back = quality_lm.unpacked(quality_lm.packed(keys[:n], np.arange(n)))
        assert (back[0] == keys[:n]).all() and (back[1] == np.arange(n)).all()
        assert (quality_lm.unpacked(quality_lm.packed(keys[:n][::-1], ordered=False), ordered=False)[0] == keys[:n][::-1]).all()


def test_rejection_is_by_row_not_by_id(spark):
    """A bad text under a null id, or under the id of a good one, takes no other row with it; null languages are one."""
    known, rng = words(50, 1), random.Random(2)
    rows = [(i, None, " ".join(rng.choices(known, k=60))) for i in range(300)]
    junk = " ".join(f"j{i}k" for i in range(60))
    rows += [(None, None, junk), (None, None, rows[0][2]), (7, None, junk), (7, None, junk), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").withColumn("text_key", F.lit(1)).withColumn("id", F.lit(2))
    labels = spark.createDataFrame([(i, 1) for i in range(300) if i != 7], "doc_id long, quality int")
    kept = quality_lm.keep_good(docs, labels)
    assert kept.columns == docs.columns
    got = collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert (None, junk) not in got and (7, junk) not in got
    assert got[None, rows[0][2]] == 1 and got[7, rows[7][2]] == 1 and got[None, None] == 1


def test_junk_is_rejected_and_clean_text_kept(spark):
    docs = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    out = quality_lm.classify(docs, labels).join(labels.withColumnRenamed("doc_id", "id"), "id")
    n = {(r["quality"], r["keep"]): r["count"] for r in out.groupBy("quality", "keep").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[(1, True)]
    assert n.get((0, False), 0) >= 0.4 * (n.get((0, False), 0) + n.get((0, True), 0))
    kept = quality_lm.keep_good(docs, labels)
    assert kept.columns == docs.columns


def test_rare_words_of_a_small_language_are_known(spark):
    rng = random.Random(5)
    common, rare = words(200, 1), [f"zq{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, "en", " ".join(rng.choices(common, k=1000))) for i in range(60)]
    rows += [(100 + i, "xx", " ".join(rng.choices(rare, k=100))) for i in range(12)]
    rows += [(200, "xx", " ".join(rng.choices(rare, k=60))), (201, "xx", " ".join(f"vw{a}{b}" for a in "abcdefgh" for b in "abcdefgh"))]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.filter("doc_id < 200").select("doc_id", F.lit(1).alias("quality"))
    got = {r["id"]: r["perplexity"] for r in quality_lm.classify(docs, labels).filter("id >= 200").collect()}
    assert got[200] < 0.5 * got[201]


def test_short_junk_is_rejected(spark):
    rng = random.Random(6)
    known = words(50, 1)
    rows = [(i, "en", " ".join(rng.choices(known, k=rng.choice([8, 40, 200])))) for i in range(400)]
    rows += [(1000 + i, "en", " ".join(f"j{i}k{chr(97 + j)}q" for j in range(8))) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.filter("doc_id < 1000").select("doc_id", F.lit(1).alias("quality"))
    out = quality_lm.classify(docs, labels)
    assert out.filter("id >= 1000 AND NOT keep").count() == 20
    assert out.filter("id < 1000 AND NOT keep").count() <= 12


def test_quality_on_odd_and_empty_tables(spark):
    df = odd_docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (6, 1), (8, 1)], "doc_id long, quality int")
    assert quality_lm.classify(df, labels).count() == df.count()
    none = quality_lm.classify(df, labels.limit(0)).collect()
    assert len(none) == df.count() and all(r["keep"] for r in none)
    assert quality_lm.classify(df.limit(0), labels).count() == 0


# -- neighbours --------------------------------------------------------------------------------------------------------


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((8, 24)) * 2
    v = centres[rng.integers(0, 8, 1500)] + rng.standard_normal((1500, 24))
    v[100:130] = v[100]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in nn_descent.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(v)), d))[:10]
        hit += len(set(best) & {i for i, _ in found})
        assert [s for _, s in found] == pytest.approx(sorted(d[i] for i, _ in found))
        if q == 100:
            assert [i for i, _ in found] == list(range(101, 111))
    assert len(got) == 15 and hit >= 0.9 * 150


def test_few_and_odd_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [0.0, 0.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit(3))
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in nn_descent.nearest(df).orderBy("rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 1, pytest.approx(2**0.5))]
    assert nn_descent.nearest(df.limit(0)).count() == 0


# -- licences and WARC -------------------------------------------------------------------------------------------------


def test_license_forms_and_near_misses(spark):
    mit = "Copyright (c) 2020 Ann\n\n" + license_scan.MIT.upper().replace("\n", "\r\n   ").replace(",", " ,")
    rows = [(1, mit), (2, license_scan.MIT + " extra"), (3, "x\nReleased under the MIT licence!\ny"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1)).withColumn("row", F.lit(2))
    got = {r["doc_id"]: (r["license_id"], list(r["notice_ids"])) for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ("MIT", []), 2: (None, []), 3: (None, ["MIT"]), 4: (None, []), 5: (None, [])}
    assert license_scan.scan_licenses(df.limit(0)).count() == 0


def test_whole_licence_texts_are_found_in_other_spellings(spark):
    """Each known text, reflowed, in capitals, with a copyright line and other spellings, and none with a word more."""
    rows = []
    for n, (_, text) in enumerate(license_scan.KNOWN_TEXTS):
        other = re.sub(r"\b([Ll])icense\b", r"\1icence", text).replace("organization", "organisation").upper().replace("\n", "  \r\n\t")
        rows += [(2 * n, "Copyright 1999-2024 The Authors\n" + other), (2 * n + 1, text + " x")]
    rows += [(-1, "licence licence x"), (-2, "license license x")]
    df = spark.createDataFrame([*rows, *rows[:2], (None, license_scan.MIT), (7777, "word " * 30_000)], "doc_id long, text string")
    out = license_scan.scan_licenses(df).collect()
    assert len(out) == len(rows) + 4
    got = {r["doc_id"]: r for r in out}
    for n, (name, _) in enumerate(license_scan.KNOWN_TEXTS):
        assert got[2 * n]["license_id"] == name and got[2 * n + 1]["license_id"] is None
    assert got[-1]["canonical_sha256"] == got[-2]["canonical_sha256"] and got[None]["license_id"] == "MIT"


def test_html_that_is_not_tidy(spark):
    """Unclosed heads, all quotings of attributes, references of every kind: expected texts written out."""
    rows = [
        (1, "<html><head><title>T</title><body><p>Body text here</p>", "Body text here"),
        (2, "<p>caf&eacute; &#39;a&#x27; &#128512; &amp;lt; &bogus; &Ntilde;&#0;&#xD800;", "café 'a' 😀 &lt; &bogus; Ñ\ufffd\ufffd"),
        (3, "<p>one<br>two<script>if (a<b) x()</script> three<style>p{}", "one\ntwo three"),
        (4, "x" * 200_000 + "<!-- never closed", "x" * 200_000),
        (5, "<?xml version='1.0'?><p>a</p>", "a"),
    ]
    links = "<html lang='de-AT'><a href='x?a=1&amp;b=2'>1</a><A class=k HREF=y>2</A><a data-href=no href = \"z\">3</a>"
    pages = spark.createDataFrame([(n, "http://a/", html) for n, html, _ in rows] + [(9, None, links)], "page_id long, url string, html string")
    pages = pages.withColumn("payload", F.lit("clash")).withColumn("record_id", F.lit(1))
    got = {(r["page_id"], r["warc_type"]): r["block"] for r in warc.derive(warc.responses(pages)).collect()}
    for n, _, text in rows:
        assert got[n, "conversion"] == text
    lines = got[9, "metadata"].split("\r\n")
    assert [x for x in lines if x.startswith("outlink")] == ["outlink: x?a=1&b=2", "outlink: y", "outlink: z"] and "language: de-AT" in lines


def test_warc_records_and_files(spark, tmp_path):
    import base64
    import gzip

    html = '<html lang="en"><head><title>A &amp; B</title></head><body><!-- x --><p>Hello <b>W</b>orld<script>no()</script><p>Next&lt;</body>'
    df = spark.createDataFrame([(1, "http://a/\r\nX: y", html), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    out = warc.derive(warc.responses(df))
    got = {(r["page_id"], r["warc_type"]): r for r in out.collect()}
    text, meta = got[(1, "conversion")], got[(1, "metadata")]
    assert text["block"] == "Hello World\nNext<" and "title: A & B\r\n" in meta["block"]
    digest = "sha1:" + base64.b32encode(hashlib.sha1(text["block"].encode()).digest()).decode()
    assert text["block_digest"] == digest and text["refers_to"] == meta["refers_to"] != text["record_id"]
    assert "source-payload-digest: " + text["source_digest"] in meta["block"] and "\n" not in text["target_uri"]
    warc.write_warc(out.coalesce(1), str(tmp_path / "w"))
    raw = gzip.decompress(next((tmp_path / "w").glob("*.gz")).read_bytes())
    records = 0
    while raw:
        head, _, rest = raw.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
        n = int(fields[b"Content-Length"])
        assert head.startswith(b"WARC/1.1") and rest[n : n + 4] == b"\r\n\r\n"
        raw, records = rest[n + 4 :], records + 1
    assert records == 6 and out.limit(0).count() == 0
