"""The pipeline's stages, each against a brute-force version on what the stage before it kept, and the queries as registered."""

import collections
import math
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from pitchlake.llm import mixing, near_dedup, quality_lm, queries
from pitchlake.llm.storage import durable
from tests.llm.test_llm_operators import brute_model, brute_near, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage returns on the smallest tables, with some odd rows among the documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = [tuple(r) for r in docs.limit(3).collect()]
    odd = [(None, None, None, None, None), (None, "a text without an id", "en", None, 1), (900_001, "", None, "web", 0), (900_002, None, "xx", "", None), some[0], some[0]]
    out = {"documents": durable(docs.unionByName(spark.createDataFrame(odd, docs.schema)))}
    for name, stage in corpus_pipeline.STAGES:
        out[name] = durable(stage(spark, out[list(out)[-1]], SF))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_stages_return_the_columns_of_documents(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_dedup", "near_dedup", "mix", "encode"]
    for name in names[:-1]:
        assert kept[name].columns == kept["documents"].columns and kept[name].count() > 0


def test_quality_stage(spark, kept):
    docs = rows(kept["documents"].select("doc_id", "text", "lang"))
    good = [r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").select("doc_id").distinct().collect()]
    ids = spark.createDataFrame([(i,) for i in good], "id long")
    held = {r["id"]: r["held"] for r in ids.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(quality_lm.HELD_OUT)) == 0).collect()}
    cost = brute_model([t or "" for i, t, _ in docs if i in held and not held[i]])
    hashes = quality_lm.Hashes()
    n = [len(quality_lm.numbers(hashes, t or "")) - 1 for _, t, _ in docs]
    nll = [cost(t or "") for _, t, _ in docs]
    trial = [k for k, (i, _, _) in enumerate(docs) if held.get(i)]
    mean = lambda ks: sum(nll[k] for k in ks) / sum(n[k] for k in ks)
    means = {lang: mean([k for k in trial if docs[k][2] == lang]) for lang in {docs[k][2] for k in trial}}
    above = [nll[k] / n[k] - means.get(docs[k][2], mean(trial)) for k in range(len(docs))]
    slope, constant = np.polyfit([1 / n[k] for k in trial], [above[k] ** 2 for k in trial], 1)
    if not slope > 0 or not constant > 0:
        slope, constant = 0.0, np.mean([above[k] ** 2 for k in trial])
    score = [a / max(math.sqrt(constant + slope / m), quality_lm.LEAST) for a, m in zip(above, n)]
    steps = sorted(math.ceil(score[k] / quality_lm.STEP) for k in trial)  # no language has enough held-out texts here
    limit = steps[math.ceil(quality_lm.QUANTILE * len(steps)) - 1] * quality_lm.STEP
    expected = collections.Counter(d[:2] for d, s, m in zip(docs, score, n) if s <= limit or m <= 1)
    assert collections.Counter(rows(kept["quality"].select("doc_id", "text"))) == expected
    assert sum(expected.values()) < len(docs)


def test_exact_stage(kept):
    by_text = collections.defaultdict(list)
    for i, t in rows(kept["quality"].select("doc_id", "text")):
        by_text[t or ""].append(-math.inf if i is None else i)
    got = rows(kept["exact_dedup"].select("doc_id", "text"))
    assert sorted((-math.inf if i is None else i, t or "") for i, t in got) == sorted((max(ids), t) for t, ids in by_text.items())


def test_near_stage(kept):
    docs = rows(kept["exact_dedup"].select("doc_id", "text"))
    groups = brute_near(list(enumerate(t or "" for _, t in docs)))
    first = lambda g: min((docs[k][0] is None, docs[k][0] or 0) for k in g)
    got = sorted((i is None, i or 0) for (i,) in rows(kept["near_dedup"].select("doc_id")))
    assert got == sorted(map(first, groups)) and len(got) < len(docs)


def test_mix_stage(kept):
    docs = rows(kept["near_dedup"])
    out = collections.Counter(rows(kept["mix"]))
    assert set(out) <= set(docs) and max(out.values()) <= 2
    size = lambda r: len([w for w in re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")])
    source = kept["near_dedup"].columns.index("source")
    have, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in docs:
        have[r[source]] += size(r)
        largest[r[source]] = max(largest[r[source]], size(r))
    for r, k in out.items():
        taken[r[source]] += k * size(r)
    names = sorted(have, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    target, open_, budget = {}, set(names), mixing.TOTAL * sum(have.values())
    while True:
        level = (budget - sum(target.values())) / max(1e-9, sum(weight[s] for s in open_))
        full = {s for s in open_ if weight[s] * level >= 2 * have[s]}
        target |= {s: 2 * have[s] for s in full}
        open_ -= full
        if not full or not open_:
            break
    target |= {s: weight[s] * level for s in open_}
    for s in names:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6


def test_encode_stage(kept):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = collections.Counter((i, tuple(ids), text) for i, ids, text in rows(kept["encode"].select("doc_id", "ids", "decoded")))
    want = collections.Counter()
    for i, t in rows(kept["mix"].select("doc_id", "text")):
        ids = [*library.encode(t or ""), library.eos_id()]
        want[i, tuple(ids), library.decode(ids)] += 1
    assert got == want


def test_run_gives_the_stages_rows(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "ids", "begins", "ends", "decoded"] and out.count() > 0


# -- queries as registered ---------------------------------------------------------------------------------------------


def documents(spark):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_query(spark):
    docs = documents(spark)
    want = {frozenset(docs[k][0] for k in g) for g in brute_near([(k, t) for k, (_, t, _) in enumerate(docs)])}
    got = collections.defaultdict(set)
    for r in queries.op1_minhash_dedup(spark, SF).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == want and near_dedup.SIMILAR == 0.8


def test_mix_query(spark):
    out = {r["doc_id"]: r for r in queries.op4_source_mix(spark, SF).collect()}
    again = {r["doc_id"]: r["taken"] for r in queries.op4_source_mix(spark, SF).collect()}
    docs = documents(spark)
    have, taken = collections.Counter(), collections.Counter()
    for i, t, s in docs:
        size = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        assert out[i]["size"] == size and out[i]["taken"] <= 2 * size and out[i]["taken"] == again[i]
        have[s] += size
        taken[s] += out[i]["taken"]
    assert all(out[i]["source_size"] == have[s] for i, _, s in docs)
    total = sum({s: out[i]["target"] for i, _, s in docs}.values())
    assert total == pytest.approx(min(1.5, 2) * sum(have.values()))
    biggest = max(r["size"] for r in out.values())
    assert all(abs(taken[s] - out[i]["target"]) <= biggest for i, _, s in docs)


def test_token_query(spark):
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op6_token_count(spark, SF).collect()}
    for i, t, _ in documents(spark):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 512)


def test_sentencepiece_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_sentencepiece(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    for i, t, _ in documents(spark):
        ids = [*library.encode(t), library.eos_id()]
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_neighbour_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], dtype=np.float64)
    got = collections.defaultdict(list)
    for r in queries.op7_nn_descent(spark, SF).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((v - v[ids == q]) ** 2).sum(1))
        d[ids == q] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        assert len(found) == 10 and [s for _, s in found] == pytest.approx([d[ids == i][0] for i, _ in found])
        hits += len(best & {i for i, _ in found})
    assert set(got) == {i for i in ids.tolist() if i % 100 == 0} and hits >= 9 * len(got)


def test_quality_query(spark):
    out = queries.op9_quality_lm(spark, SF)
    assert out.count() == len(documents(spark)) and out.filter("NOT keep").count() > 0
