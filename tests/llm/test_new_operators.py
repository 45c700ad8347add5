"""Importance resampling, spelling variants and token files: brute force, files read back, and odd input."""

import collections
import hashlib
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pitchlake.llm import importance, mixing, oracles, queries, spelling, token_files
from pitchlake.llm.storage import durable, numbered
from tests.llm.test_llm_operators import odd_docs

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
STRANGE = ["A\x00b C\x01d", "ÀB été Été x１２", "a-b_c d'e", "é́ 日本 語", " ".join("abcdefghij"[i % 10] + str(i % 7) for i in range(60))]


# -- importance resampling ---------------------------------------------------------------------------------------------


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for i in range(len(words)) for n in (1, 2, 3) if i + n <= len(words)]
    return len(words), [zlib.crc32(r.encode()) % importance.BUCKETS for r in runs]


def brute_resample(docs, targets):
    found = [(doc_id, *brute_features(text)) for doc_id, text in docs]
    s = collections.Counter(b for *_, bs in found for b in bs)
    t = collections.Counter(b for text in targets for b in brute_features(text)[1])
    S, T, n = sum(s.values()), sum(t.values()), importance.BUCKETS
    gain = {b: math.floor(1000 * math.log(((t[b] + 1) * (S + n)) / ((s[b] + 1) * (T + n)))) for b in range(n)}
    rows = []
    for doc_id, words, buckets in found:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in buckets)
        rows.append((doc_id, words, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    drawn = {}
    for place, r in enumerate(eligible[: 5 * len(eligible) // 100], 1):
        drawn.setdefault((r[0], r[4]), []).append(place)
    return rows, drawn


def test_resample_equals_brute_force(spark):
    rng = random.Random(6)
    extra = [" ".join(rng.choice("the of and cat dog sun moon".split()) for _ in range(rng.randrange(15, 60))) for _ in range(70)]
    df = odd_docs(spark, extra=[*STRANGE, *extra, "word " * 200_000])  # the last is a long text of its own batch
    target = spark.createDataFrame([("the cat and the dog",), (None,), ("",), ("Moon of the sun",)], "text string").withColumn("id", F.lit(1))
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    rows, drawn = brute_resample(docs, [r["text"] for r in target.collect()])
    out = importance.resample(df, target).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(key((r["id"], r["n_features"], r["weight"], r["score"])) for r in out) == sorted(key((r[0], *r[2:])) for r in rows)
    places = collections.defaultdict(list)
    for r in out:
        if r["rank"] is not None:
            places[r["id"], r["score"]].append(r["rank"])
    assert {k: sorted(v) for k, v in places.items()} == drawn
    assert importance.resample(df.limit(0), target).count() == 0
    assert importance.resample(df, target.limit(0)).count() == len(docs)


def test_crc_of_sliced_arrays():
    words = pa.array(["", "a", "éß", "x" * 100, "日本"])
    for part in (words, words.slice(1, 3), words.cast(pa.large_string()).slice(2), words.slice(0, 0)):
        assert importance.crc32(part).to_pylist() == [zlib.crc32(w.encode()) for w in part.to_pylist()]


def test_portions_keep_all_rows(monkeypatch):
    monkeypatch.setattr(importance, "BATCH_BYTES", 10)
    batch = pa.record_batch([pa.array(["aaaa", "", "b" * 50, "cc", "dddddd", "e"])], ["text"])
    parts = [p.column("text").to_pylist() for p in importance._portions(batch)]
    assert [t for p in parts for t in p] == batch.column("text").to_pylist() and max(map(len, parts)) < 6


def test_places_in_a_total_order(spark):
    rng = random.Random(8)
    rows = [(rng.randrange(5), i) for i in range(500)]
    out = numbered(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc("a"), F.asc("b")], "nth").collect()
    assert [(r["a"], r["b"]) for r in sorted(out, key=lambda r: r["nth"])] == sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted(r["nth"] for r in out) == list(range(500))


# -- mixing: the smallest document stays open -------------------------------------------------------------------------


def test_equal_fractions_keep_mass_and_expectation():
    rng = random.Random(3)
    for sizes, q in (([900, *[rng.randrange(1, 400) for _ in range(50)]], 0.3), ([5000, 10, 9, 3, 1], 0.55), ([7], 0.4), ([4, 4], 0.5)):
        sizes, taken_of = sorted(sizes, reverse=True), np.zeros(len(sizes))
        for seed in range(3000):
            out, held, p = mixing._settle_equal(sizes, q, random.Random(seed))
            taken = sum(s * o for s, o in zip(sizes, out)) + (sizes[held] * p if held is not None else 0)
            assert taken == pytest.approx(q * sum(sizes), abs=1e-6)
            assert held is None or len(sizes) < 20 or sizes[held] < 0.4 * max(sizes)
            taken_of += out
            if held is not None:
                taken_of[held] += p
        assert np.abs(taken_of / 3000 - q).max() < 0.06


def test_small_sources_end_near_their_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", "text")
    out = mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    for r in out.collect():
        assert abs(r["taken"] - r["target"]) <= max(r["least"], 0.03 * r["target"]), r


# -- spelling variants -------------------------------------------------------------------------------------------------


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_groups(counts):
    out = {}
    for w, n in counts.items():
        links = sorted(((-counts[v], v) for v in counts if near(w, v)))
        form = links[0][1] if links and -links[0][0] >= 5 * n else None
        out[w] = [n, form, None, len(links), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w][2] = root
    return out


@pytest.mark.parametrize("heavy", [2, 64])
def test_groups_equal_brute_force(spark, monkeypatch, heavy):
    """Words of two letters, where all bigrams are common, and of many; with ``heavy`` of 2 most links come from deletions."""
    monkeypatch.setattr(spelling, "HEAVY", heavy)
    rng = random.Random(heavy)
    words = {"".join(rng.choice("ab") for _ in range(rng.randrange(6, 9))) for _ in range(90)}
    base = ["".join(rng.choice("abcdefgßéñ") for _ in range(rng.randrange(7, 12))) for _ in range(25)]
    for w in base:
        i = rng.randrange(len(w))
        words |= {w, w[:i] + w[i + 1 :], w[:i] + "z" + w[i:], w[:i] + "y" + w[i + 1 :], w[::-1]}
    words |= {"zzabcdef" + c for c in "abcdefghijklmnop"} | {c + "yyabcdefg" for c in "abcdefghijklmnop"}
    counts = {w: 5 ** rng.randrange(1, 7) + rng.randrange(3) for w in words if len(w) >= 6}
    out = spelling.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    got = {r["word"]: [r["n"], r["form"], r["root"], r["n_near"], r["form_n"]] for r in out}
    assert got == brute_groups(counts)


def test_words_of_odd_documents(spark):
    df = odd_docs(spark, extra=["Straße-straße STRASSE straße", "letters LETTERS lettersÀ lettersà letters2letters"] * 3)
    counts = collections.Counter(w for r in df.collect() for w in re.findall("[A-Za-zÀ-ÿ]+", (r["text"] or "").translate(LOWER)) if len(w) >= 6)
    got = {r["word"]: r["n"] for r in spelling.count_words(df).collect()}
    assert got == {w: n for w, n in counts.items() if n >= 5}
    assert spelling.group_variants(spelling.count_words(df.limit(0))).count() == 0
    lone = spelling.group_variants(spark.createDataFrame([("solitary", 7)], "word string, n long")).first()
    assert (lone["root"], lone["form"], lone["n_near"]) == ("solitary", None, 0)


# -- token files -------------------------------------------------------------------------------------------------------


def library_ids(texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def local(folder):
    return folder.removeprefix("file://")


def test_files_hold_what_the_library_gives(spark):
    df = odd_docs(spark, extra=["It's I'LL 's, don't. ''", "a\x0bb\x1dc\x85d\xa0e", "ŸİK ſ ª µ", "<|endoftext|>x<|startoftext|>", *STRANGE])
    folder = token_files.write(df, length=64, rows=4)
    rows = [(r["doc_id"], r["text"] or "") for r in df.collect()]
    want = collections.Counter((str(i), tuple(ids)) for (i, _), ids in zip(rows, library_ids([t for _, t in rows])))
    read = token_files.read_documents(spark, folder, df.schema["doc_id"].dataType).orderBy("start").collect()
    assert collections.Counter((str(r["id"]), tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in read) == want
    order = [r["id"] for r in read]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    at = 0
    for r in read:
        assert r["start"] == at
        at += len(r["ids"]) // 4


def test_random_access_without_copies(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["sun", "moon", "star"]) for _ in range(rng.randrange(200)))) for i in range(300)], "doc_id long, text string")
    folder = token_files.write(df.repartition(3), length=32, rows=4)
    entries = token_files.manifest(spark, folder)
    files = token_files.TokenFiles(folder, entries)
    stream = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in token_files.read_documents(spark, folder).orderBy("start").collect()])
    back, padded = [], 0
    for i in range(len(files)):
        ids, mask = files[i]
        assert len(ids) == len(mask) == 32 and not ids.flags.owndata and not ids.flags.writeable
        back.append(ids[mask])
        padded += 32 - mask.sum()
    assert np.concatenate(back).tolist() == stream.tolist() and padded < 32 * len(entries)
    for entry in entries:  # every batch but the last has the same rows, and each reads as a plain Arrow stream
        with pa.memory_map(f"{local(folder)}/ids-{entry['shard']:05d}.arrow") as f:
            sizes = [b.num_rows for b in pa.ipc.open_stream(f)]
        assert set(sizes[:-1]) <= {4} and sum(sizes) == entry["n_sequences"]
    assert not [f for f in os.listdir(local(folder)) if f.endswith(".part")]
    with pytest.raises(IndexError):
        files[len(files)]


def test_no_documents_no_files(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    folder = token_files.write(df)
    assert token_files.read_documents(spark, folder).count() == 0 and len(token_files.TokenFiles(folder, token_files.manifest(spark, folder))) == 0


def test_other_tokenizers_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError, match="white space"):
        token_files.write(df, tokenizer="byte_bpe_50k.json")


def test_query_13_equals_the_library(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    want, at = {}, 0
    for (doc_id, _), ids in zip(docs, library_ids([t for _, t in docs])):
        want[doc_id] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in queries.op13_token_files(spark, SF).collect()}
    assert got == want


@pytest.mark.parametrize("name", ["op11_importance_resampling", "op12_spelling_variants"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(oracles.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r[c] for c in columns) for r in queries.queries()[name](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want.fetchall()))


def test_words_without_a_letter_are_never_broadcast(spark):
    words = durable(spark.createDataFrame([("abcdef", 9), ("abcdeg", 5), ("abcde", 7)], "word string, n long"))
    assert "BroadcastHashJoin" not in spelling._by_deletion(words)._jdf.queryExecution().executedPlan().toString()
    assert {(r["a"], r["b"]) for r in spelling._by_deletion(words).collect()} >= {("abcdef", "abcdeg"), ("abcde", "abcdef"), ("abcde", "abcdeg")}
