"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text, and thresholds by language.

Words and punctuation runs are hashed, so every trusted token is in the vocabulary; a word that repeats the word before it is
``<rep>``. Documents are tokenised once, in chunks of about ``CHUNK`` tokens that are written in buckets and then stay where
they are. A chunk sends each of its distinct bigrams once, with its trusted occurrences, to the shard of its key (a range of key
hashes). The shard sums the occurrences, tells every chunk the sum and one chunk that the bigram is its own. So each bigram of
the model is known in one place as two words, from where the shards of words learn of the contexts and continuations, and tell
them to the chunks. No count or share is too small: the model grows with the trusted text.

Counting and looking up are one exchange: a common bigram costs an entry a chunk, not one an occurrence, and no task or driver
holds the model.

Four fifths of the trusted documents train the model, the rest set the thresholds. A document's score is how far its mean
negative log probability a token lies above its language's mean, in standard deviations of a text of its length: the variance
is fitted to the held-out texts as a constant plus a share of 1 / length. The threshold is the ``QUANTILE`` of the held-out
scores of the language, or of all where it has fewer than ``ENOUGH``. Documents above it are rejected.

Defined results: null text counts as empty and is kept; null is a language of its own; one output row per input row, repeated
rows and null ids included; without trusted text everything is kept; an empty table gives an empty table; the other columns
of either table may bear any name. Repeated labels of a document count once; it is trusted if any of them says so. Keys are
48-bit hashes: a token or bigram that is not in the model is taken for another one with a chance of their number / 2**48.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitchlake.llm.shingles import mix
from pitchlake.llm.storage import bucketed, durable, released, tidy

QUANTILE = 0.99
ENOUGH = 100
#: The least standard deviation, in nats a token; steps of scores in which quantiles are counted.
LEAST = 0.05
STEP = 0.001
HELD_OUT = 5
START, END, REPEATED = 0, 1, 2
#: Tokens of a chunk of documents, characters that are looked at together, and tokens of all documents for each shard.
CHUNK = 1 << 21
PIECE = 1 << 18
PER_SHARD = 1 << 22
LEAST_SHARDS = 12
KEY_BITS = 48
TOKEN = re.compile(r"\w+|[^\w\s]+")
SPACE = re.compile(r"\s")
#: Tokens of more characters are hashed one by one.
LONG = 64
_POWERS = np.cumprod(np.array([1] + [0x9E3779B97F4A7C15] * (LONG - 1), np.uint64))


class Hashes(dict):
    """Token -> 64-bit hash; a bounded number of them is remembered."""

    def __missing__(self, token: str) -> int:
        number = int.from_bytes(hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
        if len(self) < 200_000:
            self[token] = number
        return number


def numbers(hashes: Hashes, text: str) -> list[int]:
    """The text's tokens between a start and an end; ``REPEATED`` for a word equal to the word before it, whatever
    punctuation is between them."""
    out, before = [START], None
    for token in TOKEN.findall(text):
        if token[0].isalnum() or token[0] == "_":
            out.append(REPEATED if token == before else hashes[token])
            before = token
        else:
            out.append(hashes[token])
    out.append(END)
    return out


@functools.cache
def _kinds() -> np.ndarray:
    """What each code point is: 0 white space, 1 part of a word, 2 anything else."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), 2, np.uint8)
    for kind, pattern in enumerate((r"\s+", r"\w+")):
        for run in re.finditer(pattern, every):
            out[run.start() : run.end()] = kind
    return out


def _tokens(hashes: Hashes, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens of ``text``, whether each is a word, and where it begins."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _kinds()[points]
    edges = np.flatnonzero(np.diff(kind, prepend=np.uint8(9), append=np.uint8(9)))
    starts, sizes = edges[:-1], np.diff(edges)
    token = kind[starts] > 0
    starts, sizes = starts[token], sizes[token]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, bool), starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
    terms = (points[kind > 0].astype(np.uint64) + np.uint64(1)) * _POWERS[np.minimum(place, LONG - 1)]
    out = mix(np.add.reduceat(terms, first)).view(np.int64)
    for n in np.flatnonzero(sizes > LONG):
        out[n] = hashes[text[starts[n] : starts[n] + sizes[n]]]
    return out, kind[starts] == 1, starts


def numbered_tokens(hashes: Hashes, texts: list[str]) -> Iterator[np.ndarray]:
    """``numbers`` of each text with other hashes, by array operations on about ``PIECE`` characters at a time."""

    def finished(token: np.ndarray, word: np.ndarray, owner: np.ndarray, n: int) -> Iterator[np.ndarray]:
        at = np.flatnonzero(word)
        again = (token[at[1:]] == token[at[:-1]]) & (owner[at[1:]] == owner[at[:-1]])
        token[at[1:][again]] = REPEATED
        cuts = np.searchsorted(owner, np.arange(n + 1))
        for a, b in zip(cuts, cuts[1:]):
            yield np.concatenate([[START], token[a:b], [END]])

    def together(group: list[str]) -> Iterator[np.ndarray]:
        token, word, starts = _tokens(hashes, "\n".join(group))
        return finished(token, word, np.searchsorted(np.cumsum([len(t) + 1 for t in group]), starts, side="right"), len(group))

    group, size = [], 0
    for text in texts:
        if group and size + len(text) > PIECE:
            yield from together(group)
            group, size = [], 0
        if len(text) <= PIECE:
            group.append(text)
            size += len(text)
            continue
        parts, start = [], 0
        while start < len(text):  # cut where there is white space
            cut = SPACE.search(text, start + PIECE)
            stop = cut.start() if cut else len(text)
            parts.append(_tokens(hashes, text[start:stop])[:2])
            start = stop
        token, word = (np.concatenate(x) for x in zip(*parts))
        yield from finished(token, word, np.zeros(len(token), np.int64), 1)
    if group:
        yield from together(group)


def word_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens.view(np.uint64) + np.uint64(1)) >> np.uint64(64 - KEY_BITS)


def pair_keys(b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Keys of the bigrams of words with the keys ``b`` and ``w``."""
    return mix(mix(b) * np.uint64(3) + w) >> np.uint64(64 - KEY_BITS)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shards of keys, in the order of the keys."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


# -- packed arrays -----------------------------------------------------------------------------------------------------


def packed(*columns: np.ndarray, ordered: bool = True) -> bytes:
    """Columns of whole numbers, byte plane by byte plane and compressed; the first, if it is sorted, as differences."""
    n = len(columns[0])
    if ordered:
        columns = [np.diff(columns[0].astype(np.uint64), prepend=np.uint64(0)), *columns[1:]]
    planes = np.concatenate([c.astype("<u8").view(np.uint8).reshape(n, 8).T.reshape(-1) for c in columns])
    return np.array([n, len(columns)], "<i8").tobytes() + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(blob: bytes, ordered: bool = True) -> list[np.ndarray]:
    n, k = np.frombuffer(blob, "<i8", 2).tolist()
    raw = np.frombuffer(pa.decompress(blob[16:], decompressed_size=8 * n * k, codec="zstd", asbytes=True), np.uint8)
    columns = [np.ascontiguousarray(c.reshape(8, n).T).view("<u8").reshape(-1) for c in raw.reshape(k, 8 * n)] if n else [np.zeros(0, np.uint64)] * k
    return [np.cumsum(columns[0], dtype=np.uint64), *columns[1:]] if ordered else columns


def by_shard(shards: int, keys: np.ndarray, *more: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(shard, packed columns) for sorted keys and what belongs to them."""
    shard = shard_of(keys, shards)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1, append=-1))
    for a, b in zip(cuts, cuts[1:]):
        yield int(shard[a]), packed(*(c[a:b] for c in (keys, *more)))


def summed(keys: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return [keys[first], *(np.add.reduceat(c[order], first) if len(keys) else c for c in counts)]


def found(keys: np.ndarray, values: list[np.ndarray], want: np.ndarray) -> list[np.ndarray]:
    """The values of the keys ``want``, 0 for those that are not among the sorted ``keys``."""
    if not len(keys):
        return [np.zeros(len(want), np.uint64) for _ in values]
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    hit = keys[at] == want
    return [np.where(hit, v[at], np.uint64(0)) for v in values]


# -- chunks ------------------------------------------------------------------------------------------------------------


def encode(docs: DataFrame) -> DataFrame:
    """Chunks of a table (id, lang, text, text_key): (chunk, ids, langs, text_keys, sizes, words, local): ``words`` are the
    keys of the distinct tokens, the most frequent first, ``local`` says which of them stands where."""
    id_type = docs.schema["id"].dataType.simpleString()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 32, 0
        hashes = Hashes()
        parts, kept, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            tokens, local, often = np.unique(np.concatenate(kept), return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")
            rank = np.empty(len(order), np.uint64)
            rank[order] = np.arange(len(order), dtype=np.uint64)
            one = lambda arrays: pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), pa.concat_arrays(arrays))
            columns = [
                pa.array([task + done], pa.int64()),
                *(one([p[i] for p in parts]) for i in range(3)),
                one([pa.array([len(t) for t in kept], pa.int32())]),
                pa.array([packed(word_keys(tokens[order]), ordered=False)], pa.binary()),
                pa.array([packed(rank[local], ordered=False)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["chunk", "ids", "langs", "text_keys", "sizes", "words", "local"])

        for batch in batches:
            start = 0
            for n, tokens in enumerate(numbered_tokens(hashes, [t or "" for t in batch.column(2).to_pylist()])):
                kept.append(tokens)
                size += len(kept[-1])
                if size >= CHUNK or n == batch.num_rows - 1:
                    # Copies: a slice would keep the batch's texts.
                    parts.append([pa.array(c.slice(start, n + 1 - start).to_pylist(), c.type) for c in (batch.column(i) for i in (0, 1, 3))])
                    start = n + 1
                if size >= CHUNK:
                    yield chunk()
                    done += 1
                    parts, kept, size = [], [], 0
        if kept:
            yield chunk()

    schema = f"chunk long, ids array<{id_type}>, langs array<string>, text_keys array<long>, sizes array<int>, words binary, local binary"
    return docs.mapInArrow(tidy(apply), schema)


def rows_of(batch: pa.RecordBatch) -> Iterator[list]:
    """Rows one at a time: a batch may hold many chunks."""
    for n in range(batch.num_rows):
        yield [column[n].as_py() for column in batch.columns]


class Tokens:
    """The token keys of a chunk and its bigrams, those inside one document: ``pair`` numbers each where it stands, ``pairs``
    are the distinct ones, ``b`` and ``w`` their words' places in ``words``."""

    def __init__(self, words: bytes, local: bytes, sizes: np.ndarray):
        self.words, local = unpacked(words, ordered=False)[0], unpacked(local, ordered=False)[0].view(np.int64)
        self.inside = np.ones(len(local), dtype=bool)
        self.inside[np.cumsum(sizes) - 1] = False
        self.inside = self.inside[:-1]
        self.pair = local[:-1][self.inside] * len(self.words) + local[1:][self.inside]
        self.pairs = np.unique(self.pair)
        self.b, self.w = np.divmod(self.pairs, len(self.words))

    def keys(self) -> np.ndarray:
        """The keys of ``pairs``."""
        return pair_keys(self.words[self.b], self.words[self.w])

    def often(self, chosen: np.ndarray) -> np.ndarray:
        """How often each of ``pairs`` begins at a ``chosen`` token."""
        found, n = np.unique(self.pair[chosen[:-1][self.inside]], return_counts=True)
        out = np.zeros(len(self.pairs), np.uint64)
        out[np.searchsorted(self.pairs, found)] = n
        return out


# -- the model ---------------------------------------------------------------------------------------------------------


@dataclass
class Model:
    """What each shard tells each chunk, packed in the order of the chunk's keys: of bigrams twice the count, and 1 where the
    bigram is the chunk's own; of words the sum of their bigrams as contexts, those of count 1, 2 and more, and the contexts
    before them. The discounts; the number of distinct bigrams and of distinct words."""

    answers: DataFrame
    discounts: list[float]
    bigrams: int
    words: int

    def log_probabilities(self, c: np.ndarray, context: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        """Of words with ``c`` occurrences in their context, whose counts are ``context``, and ``before`` contexts in all."""
        d = np.array([0.0, *self.discounts])
        rest = 0.5 * self.words / (self.words + 1) / self.bigrams if self.bigrams else 1.0
        low = np.where(before > 0, (before.astype(float) - 0.5) / max(1, self.bigrams), 0.0) + rest
        total, *often = (x.astype(float) for x in context)
        safe = np.maximum(total, 1.0)
        own = np.where(c > 0, c.astype(float) - d[np.minimum(c, 3).astype(np.int64)], 0.0) / safe
        gamma = sum(x * y for x, y in zip(d[1:], often)) / safe
        return np.log(np.where(total > 0, own + gamma * low, low))


def _discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Modified Kneser-Ney's discounts of the counts 1, 2 and more, from the counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(x, 0.1), k - 0.1 if k > 1 else 0.9) for k, x in enumerate(raw, 1)]


ANSWER = "kind string, chunk long, shard long, pack binary, n0 long, n1 long, n2 long, n3 long, n4 long"
_ANSWER = pa.schema([("kind", pa.string()), ("chunk", pa.int64()), ("shard", pa.int64()), ("pack", pa.binary()), *((f"n{k}", pa.int64()) for k in range(5))])
_ASKED = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("pack", pa.binary())])


def _answered(kind: str, asked: pa.Table, packs: list[bytes], numbers: list[int]) -> pa.Table:
    """A shard's answers, and numbers of the shard in the first of them."""
    columns = [np.append(n, np.zeros(len(packs) - 1, np.int64)) for n in [*numbers, *[0] * (5 - len(numbers))]]
    return pa.table([[kind] * len(packs), asked["chunk"], asked["shard"], packs, *columns], schema=_ANSWER)


def _told(answers: list[dict], kind: str) -> list[np.ndarray]:
    """The columns of all shards' answers to a chunk, in the order of its keys."""
    return [np.concatenate(x) for x in zip(*(unpacked(r["pack"], ordered=False) for r in answers if r["kind"] == kind))]


def train(chunks: DataFrame, shards: int) -> Model:
    """The model of the documents of ``chunks`` whose places are listed in its column ``trusted``, as far as ``chunks`` need it."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, sizes, words, local, trusted in rows_of(batch):
                tokens = Tokens(words, local, np.array(sizes))
                chosen = np.zeros(len(sizes), dtype=bool)
                chosen[trusted or []] = True
                rows = [(n, s, p) for s, p in by_shard(shards, *summed(tokens.keys(), tokens.often(np.repeat(chosen, sizes))))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _ASKED.types)], schema=_ASKED)

    def count(asked: pa.Table) -> pa.Table:
        asked = asked.sort_by("chunk")
        each = [unpacked(p) for p in asked["pack"].to_pylist()]
        keys, c = summed(*(np.concatenate(x) for x in zip(*each)))
        owned, packs = np.zeros(len(keys), dtype=bool), []
        for key, n in each:
            at = np.searchsorted(keys, key)
            own = (n > 0) & ~owned[at]
            owned[at[own]] = True
            packs.append(packed(c[at] * np.uint64(2) + own.astype(np.uint64), ordered=False))
        return _answered("bigrams", asked, packs, [int((c > 0).sum()), *(int((c == k).sum()) for k in (1, 2, 3, 4))])

    def tell(texts: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(texts["words"][0].as_py(), texts["local"][0].as_py(), texts["sizes"].combine_chunks().flatten().to_numpy())
        (told,) = _told(answers.sort_by("shard").to_pylist(), "bigrams")
        own = np.unique(tokens.keys(), return_index=True)[1][told & np.uint64(1) == 1]
        c = told[told & np.uint64(1) == 1] >> np.uint64(1)
        b, w, n = tokens.b[own], tokens.w[own], len(tokens.words)
        sums = [np.bincount(b, c, n), *(np.bincount(b[x], minlength=n) for x in (c == 1, c == 2, c > 2)), np.bincount(w, minlength=n)]
        rows = list(by_shard(shards, *summed(tokens.words, *(x.astype(np.uint64) for x in sums))))
        released()
        return pa.table([[texts["chunk"][0].as_py()] * len(rows), *map(list, zip(*rows))], schema=_ASKED)

    def merge(asked: pa.Table) -> pa.Table:
        each = [unpacked(p) for p in asked["pack"].to_pylist()]
        keys, *sums = summed(*(np.concatenate(x) for x in zip(*each)))
        packs = [packed(*found(keys, sums, key[0]), ordered=False) for key in each]
        return _answered("words", asked, packs, [int((sums[-1] > 0).sum())])

    schema = "chunk long, shard long, pack binary"
    asked = chunks.select("chunk", "sizes", "words", "local", "trusted").mapInArrow(tidy(ask), schema)
    bigrams = durable(asked.groupBy("shard").applyInArrow(count, ANSWER))
    texts = chunks.select("chunk", "sizes", "words", "local")
    partial = texts.groupBy("chunk").cogroup(bigrams.groupBy("chunk")).applyInArrow(tell, schema)
    words = durable(partial.groupBy("shard").applyInArrow(merge, ANSWER))
    n = [x or 0 for x in bigrams.agg(*[F.sum(f"n{k}") for k in range(5)]).first()]
    n_words = words.agg(F.sum("n0")).first()[0] or 0
    return Model(bigrams.union(words).select("kind", "chunk", "shard", "pack"), _discounts(*n[1:]), n[0], n_words)


def score(chunks: DataFrame, model: Model) -> DataFrame:
    """(id, lang, text_key, n_tokens, nll) of the documents of ``chunks``: the number of predictions and their summed cost."""
    id_type = chunks.schema["ids"].dataType.elementType.simpleString()
    costs = Model(None, model.discounts, model.bigrams, model.words)  # what tasks need of it

    def apply(texts: pa.Table, answers: pa.Table) -> pa.Table:
        ids, langs, text_keys, sizes = (texts[c].combine_chunks().flatten() for c in ("ids", "langs", "text_keys", "sizes"))
        tokens = Tokens(texts["words"][0].as_py(), texts["local"][0].as_py(), sizes.to_numpy())
        answers = answers.sort_by("shard").to_pylist()
        (c,), (*context, before) = _told(answers, "bigrams"), _told(answers, "words")
        at = np.unique(tokens.keys(), return_inverse=True)[1]
        place = np.unique(tokens.words, return_inverse=True)[1]
        c, b, w = c[at] >> np.uint64(1), place[tokens.b], place[tokens.w]
        cost = -costs.log_probabilities(c, [x[b] for x in context], before[w])[np.searchsorted(tokens.pairs, tokens.pair)]
        n = sizes.to_numpy().astype(np.int64) - 1
        released()
        return pa.table({"id": ids, "lang": langs, "text_key": text_keys, "n_tokens": n, "nll": np.add.reduceat(cost, np.cumsum(n) - n)})

    both = chunks.groupBy("chunk").cogroup(model.answers.groupBy("chunk"))
    return both.applyInArrow(apply, f"id {id_type}, lang string, text_key long, n_tokens long, nll double")


# -- the decision ------------------------------------------------------------------------------------------------------


def _quantiles(scores: DataFrame) -> DataFrame:
    """(every, lang, held, limit): the ``QUANTILE`` of the scores of each language, and of all where ``every``, to a ``STEP``.

    Scores are counted in steps, and a window runs over a language's steps: their number does not grow with the rows.
    """
    step = F.ceil(F.least(F.greatest(F.col("score"), F.lit(-1e3)), F.lit(1e3)) / STEP).cast("long")
    every = F.explode(F.array(F.lit(False), F.lit(True))).alias("every")
    counts = scores.select("lang", step.alias("step"), every).withColumn("lang", F.when(~F.col("every"), F.col("lang")))
    counts = counts.groupBy("every", "lang", "step").agg(F.count("*").alias("n"))
    by = Window.partitionBy("every", "lang")
    upto = F.sum("n").over(by.orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("upto", upto).withColumn("held", F.sum("n").over(by)).filter(F.col("upto") >= QUANTILE * F.col("held"))
    return counts.groupBy("every", "lang", "held").agg((F.min("step") * STEP).alias("limit"))


def _classified(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, trusted: str) -> DataFrame:
    text = F.coalesce(df[text_col], F.lit(""))
    docs = df.select(df[id_col].alias("id"), df[lang_col].cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    chunks = bucketed(encode(docs), "chunk")
    total = chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda n, x: n + x))).first()[0] or 0
    ids = labels.filter(trusted).select(F.col(id_col).alias("id")).filter("id IS NOT NULL").distinct()
    good = durable(ids.withColumn("held", F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0))
    places = chunks.select("chunk", F.posexplode("ids").alias("place", "id")).join(good.filter("not held").select("id"), "id", "left_semi")
    places = durable(places.groupBy("chunk").agg(F.collect_list("place").alias("trusted")))  # a chunk's own documents
    model = train(chunks.join(places, "chunk", "left"), max(LEAST_SHARDS, -(-total // PER_SHARD)))
    scored = durable(score(chunks, model))

    trial = scored.join(good.filter("held").select("id"), "id", "left_semi")
    mean = F.sum("nll") / F.sum("n_tokens")
    per_lang = durable(trial.groupBy("lang").agg(mean.alias("mean")))
    overall = trial.agg(mean.alias("all_mean")).first()[0]

    def above(rows: DataFrame) -> DataFrame:
        joined = rows.alias("r").join(per_lang.alias("m"), F.col("r.lang").eqNullSafe(F.col("m.lang")), "left")
        usual = F.coalesce("m.mean", F.lit(overall).cast("double"), F.lit(0.0))
        return joined.select("r.*", (F.col("r.nll") / F.col("r.n_tokens") - usual).alias("above"))

    square, inverse = F.col("above") * F.col("above"), 1 / F.col("n_tokens")
    fitted = above(trial).agg(
        F.regr_slope(square, inverse).alias("slope"), F.regr_intercept(square, inverse).alias("constant"), F.avg(square).alias("flat")
    ).first()
    slope, constant = fitted["slope"], fitted["constant"]
    if slope is None or constant is None or not slope > 0 or not constant > 0:
        slope, constant = 0.0, fitted["flat"] or 1.0  # too few texts, or of too few lengths, to tell

    def scores(rows: DataFrame) -> DataFrame:
        deviation = F.greatest(F.sqrt(F.lit(constant) + F.lit(slope) / F.col("n_tokens")), F.lit(LEAST))
        return above(rows).withColumn("score", F.col("above") / deviation).drop("above")

    limits = durable(_quantiles(scores(trial)))
    by_lang = limits.filter(~F.col("every") & (F.col("held") >= ENOUGH)).select("lang", "limit")
    everywhere = (limits.filter("every").select("limit").first() or [None])[0]
    judged = scores(scored).alias("r").join(by_lang.alias("t"), F.col("r.lang").eqNullSafe(F.col("t.lang")), "left")
    threshold = F.coalesce("t.limit", F.lit(everywhere).cast("double"))
    return judged.select(
        "r.id",
        "r.lang",
        "r.text_key",
        "r.n_tokens",
        F.exp(F.col("r.nll") / F.col("r.n_tokens")).alias("perplexity"),
        "r.score",
        threshold.alias("threshold"),
        (threshold.isNull() | (F.col("r.score") <= threshold) | (F.col("r.n_tokens") <= 1)).alias("keep"),
    )


def classify(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trusted: str = "quality = 1",
) -> DataFrame:
    """(id, lang, n_tokens, perplexity, score, threshold, keep), one narrow row per row of ``df``."""
    return _classified(df, labels, id_col, text_col, lang_col, trusted).drop("text_key")


def keep_good(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    trusted: str = "quality = 1",
) -> DataFrame:
    """The rows of ``df`` that are not rejected, with its own columns.

    A row is known by its id, language and text, null ids and languages included, so another text of the same id stays.
    """
    judged = _classified(df, labels, id_col, text_col, lang_col, trusted)
    bad = durable(judged.filter(~F.col("keep")).select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), F.col("text_key").alias("_key")).distinct())
    same = df[id_col].eqNullSafe(bad["_id"]) & df[lang_col].cast("string").eqNullSafe(bad["_lang"])
    return df.join(bad, same & (F.xxhash64(F.coalesce(df[text_col], F.lit(""))) == bad["_key"]), "left_anti")
