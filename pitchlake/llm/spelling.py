"""Groups of spelling variants: words of a corpus at edit distance one, joined by their rarest bigrams.

A word of m code points has m - 1 positional bigrams, and one edit destroys two of them at most. So of two near words, the
first preserved bigram in any order that both share is among the three first of each. The order is global: rare bigrams
first, then by text and position; only three bigrams of a word are joined. The preserved bigram keeps its position or shifts
by one, and the edit lies on one side of it: up to it the words are equal, or from it on. The join key is therefore that equal
side with the word's length, from the shorter word to its own length and the next one; candidates are verified.

A key that more than ``HEAVY`` words share is not joined pair by pair: words that meet such a key are joined by what is left
of them with one code point deleted. Two near words agree there (or one is what is left of the other), and as at most one
word for each letter of the alphabet agrees in one place, rows stay linear. Both ways find every link.

Tables of words meet by sort-merge joins: Spark takes exploded rows for as few as the compressed file that they come from, and
would gather them in the driver to broadcast them.

A word's form is the near word that is most frequent, where it is at least ``TIMES`` as frequent; following forms leads to
the root. Frequencies grow by that factor at each step, so chains are short; pointers are doubled until none moves.

Defined results: null texts have no words, a null id counts as the empty string; repeated rows count again; an empty table
gives an empty table; words of fewer than ``LEAST_LETTERS`` code points or ``LEAST_COUNT`` occurrences are no words; ties go
to the smallest in code-point order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.storage import durable

LEAST_LETTERS = 6
LEAST_COUNT = 5
TIMES = 5
#: Words of a key that are still joined pair by pair.
HEAVY = 64
#: Distinct bigrams up to which their frequencies are broadcast.
MAX_BROADCAST = 100_000
RUN = r"[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def without(word: Column, at: Column) -> Column:
    """``word`` without its code point ``at`` (from 0)."""
    return F.concat(word.substr(F.lit(1), at), word.substr(at + 2, F.length(word)))


def count_words(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    spell: Callable[[Column, Column], Column] | None = None,
    least_letters: int = LEAST_LETTERS,
    least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): the words of all texts, as ``spell(id, run)`` gives them."""
    ids = F.coalesce(df[id_col].cast("string"), F.lit("")).alias("id")
    runs = F.regexp_extract_all(F.translate(df[text_col], UPPER, UPPER.lower()), F.lit(RUN), F.lit(0))
    words = df.select(ids, F.explode(runs).alias("run"))
    word = spell(F.col("id"), F.col("run")) if spell else F.col("run")
    counted = words.select(word.alias("word")).filter(F.length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least_count)


def rare_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, size, at): three rows a word, the positions of its rarest bigrams."""
    cut = F.transform(F.sequence(F.lit(0), F.length("word") - 2), lambda p: F.struct(F.col("word").substr(p + 1, F.lit(2)).alias("gram"), p.alias("at")))
    grams = words.select("word", "n", F.explode(cut).alias("g")).select("word", "n", "g.gram", "g.at")
    often = durable(grams.groupBy("gram").agg(F.count("*").alias("often")))
    known = F.broadcast(often) if often.count() <= MAX_BROADCAST else often.hint("merge")
    # Dealt by word before the bigrams are exploded: what follows needs no other shuffle where frequencies are broadcast.
    grams = words.repartition("word").select("word", "n", F.explode(cut).alias("g")).select("word", "n", "g.gram", "g.at")
    listed = grams.join(known, "gram").groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("often", "gram", "at"))).alias("all"))
    rarest = listed.select("word", "n", F.explode(F.slice("all", 1, 3)).alias("g"))
    return rarest.select("word", "n", F.length("word").alias("size"), F.col("g.at").alias("at"))


def _sides(rare: DataFrame) -> DataFrame:
    """Two rows a bigram: the word up to it, and the word from it on."""
    word, at = F.col("word"), F.col("at")
    up_to = F.struct(F.lit("<").alias("side"), word.substr(F.lit(1), at + 2).alias("part"))
    onward = F.struct(F.lit(">").alias("side"), word.substr(at + 1, F.col("size")).alias("part"))
    return rare.select("word", "n", "size", F.explode(F.array(up_to, onward)).alias("s")).select("word", "n", "size", "s.side", "s.part").distinct()


def _by_keys(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links found by light keys, and the words that meet a heavy one."""
    key = ["side", "part", "size"]
    sides = durable(_sides(rare_bigrams(words)))
    heavy = durable(sides.groupBy(*key).agg(F.count("*").alias("words")).filter(F.col("words") > HEAVY).drop("words"))
    ask = sides.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    asked = ask.select(*key, F.col("word").alias("a"), F.col("n").alias("n_a"))
    held = sides.join(heavy, key, "left_anti").select(*key, F.col("word").alias("b"), F.col("n").alias("n_b"))
    pairs = asked.join(held.hint("merge"), key).filter((F.length("a") < F.col("size")) | (F.col("a") < F.col("b")))
    near = pairs.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")
    crowded = ask.join(heavy, key, "left_semi").select("word", "n").distinct()  # its own length is among those asked
    return near, crowded


def _by_deletion(words: DataFrame) -> DataFrame:
    """All links among ``words``."""
    at = F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("at")
    left = words.select("word", "n", at).select("word", "n", "at", without(F.col("word"), F.col("at")).alias("rest"))
    a = left.select(F.col("word").alias("a"), F.col("n").alias("n_a"), "at", "rest")
    b = left.select(F.col("word").alias("b"), F.col("n").alias("n_b"), "at", "rest")
    replaced = a.join(b.hint("merge"), ["at", "rest"]).filter(F.col("a") < F.col("b"))
    whole = words.select(F.col("word").alias("rest"), F.col("word").alias("a"), F.col("n").alias("n_a"))
    deleted = whole.join(b.hint("merge"), "rest")
    return replaced.select("a", "n_a", "b", "n_b").unionByName(deleted.select("a", "n_a", "b", "n_b"))


def links(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once. ``words`` is read several times: pass a written table."""
    near, crowded = _by_keys(words)
    crowded = durable(crowded)
    return durable(near.unionByName(_by_deletion(crowded)).distinct())


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): pointers are doubled until none moves."""
    roots = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = durable(roots.join(ahead.hint("merge"), "root", "left"))
        roots = moved.select("word", F.coalesce("next", "root").alias("root"))
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return roots


def group_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, form, root, n_near, form_n) for (word, n)."""
    words = durable(words)
    found = links(words)
    both = found.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")).unionByName(
        found.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    )
    best = F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best")
    near = both.groupBy("word").agg(F.count("*").alias("n_near"), best)
    joined = words.join(near.hint("merge"), "word", "left")
    follows = -F.col("best.less") >= times * F.col("n")
    known = durable(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(follows, F.col("best.other")).alias("form"),
            F.when(follows, -F.col("best.less")).alias("form_n"),
        )
    )
    roots = _roots(known.filter(F.col("form").isNotNull()))
    return known.join(roots.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))
