"""Token counts by a lazily compiled deterministic transducer, with chunk maps that compose.

The byte-level BPE tokenizer is compiled into one transducer over characters. Its states pair the state of the splitting
pattern with the state of BPE inside the current split; every transition carries the number of tokens it adds (negative
where a character makes earlier tokens merge). The count of a text is the sum along its path: one dictionary step a
character. States are compiled when first reached and dropped together when there are too many, so memory is bounded.

Between a character that is not white space and one that is, every split ends whatever came before. A chunk of a text is
summarised as (head up to the first such place, tokens up to the last, tail); these maps compose associatively, so chunks
of a huge text are counted apart, on any executor, and combined pairwise.

Defined results: null text counts as empty; one output row per input row, repeated rows and null ids included; an empty
table gives an empty table; other columns are ignored. The tokenizer's special strings are single tokens, as its library
has them by default.
"""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.bpe_automaton import LastTokens
from pitchlake.llm.storage import durable

#: Characters of a text that one chunk holds.
CHUNK = 1 << 15
#: Compiled states kept at a time, in each Python worker.
MAX_STATES = 250_000
#: Characters after which their number is looked at.
STRIDE = 1 << 14
LIMIT = 512

# The characters that the pattern's \s stands for.
SPACE = set("\t\n\x0b\x0c\r \x85\xa0                　")


def _byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the 256 bytes: Latin-1's visible characters stand for themselves, the others follow 255."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in shown}
    for nth, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + nth)] = b
    return out


#: Where BPE stands in a split: suffix and last tokens as in LastTokens, and the tokens that each byte of the suffix added.
Reach = tuple[bytes, tuple, tuple]
ROOT: Reach = (b"", (None,), ())


class Bpe:
    """Byte-pair encoding as an automaton over bytes."""

    def __init__(self, vocab: dict[str, int], merges: list):
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.rank = {(raw(a), raw(b)): n for n, (a, b) in enumerate(pairs)}
        self.last = LastTokens(map(raw, vocab), self.encode)

    def encode(self, data: bytes) -> list[bytes]:
        """Plain BPE, for two tokens at most."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank = self.rank
        while len(parts) > 1:
            ranks = [rank.get(ab, 1 << 30) for ab in zip(parts, parts[1:])]
            low = min(ranks)
            if low == 1 << 30:
                break
            i = ranks.index(low)
            left, right = parts[i], parts[i + 1]
            merged, i = [], 0
            while i < len(parts):
                if parts[i] == left and i + 1 < len(parts) and parts[i + 1] == right:
                    merged.append(left + right)
                    i += 2
                else:
                    merged.append(parts[i])
                    i += 1
            parts = merged
        return parts

    def step(self, reach: Reach, byte: int) -> tuple[Reach, int]:
        """(where it stands next, tokens added) on one byte."""
        suffix, lasts, added = reach
        _, at, suffix, lasts, cut = self.last.extend(suffix, lasts, bytes((byte,)))
        delta = 1 - sum(added[at:])
        return (suffix, lasts, (*added[cut:], delta)), delta

    def walk(self, reach: Reach, char: str) -> tuple[Reach, int]:
        total = 0
        for byte in char.encode("utf-8", "surrogatepass"):
            reach, delta = self.step(reach, byte)
            total += delta
        return reach, total


def kind_of(char: str) -> str:
    """L letter, N number, S space, W other white space, O anything else."""
    if char in SPACE:
        return "S" if char == " " else "W"
    first = unicodedata.category(char)[0]
    return first if first in "LN" else "O"


class State(dict):
    """A compiled state: character -> (next state, tokens added). ``closing`` is added where a text ends here."""

    __slots__ = ("machine", "mode", "bpe", "last", "gain", "closing")

    def __missing__(self, char: str):
        found = self[char] = self.machine.compile(self, char)
        return found


#: The contractions the pattern splits off: what may follow an apostrophe, and what must follow that.
_SHORT = {"s": None, "t": None, "m": None, "d": None, "r": "e", "v": "e", "l": "l"}


class Transducer:
    """The tokenizer over characters. Modes: L, N, O runs; S1 a lone space, W1 lone other white space, SN two and more;
    A an apostrophe that opens a split; A? an apostrophe and one letter of a contraction; C a whole contraction."""

    def __init__(self, bpe: Bpe, special: list[str]):
        self.bpe, self.special = bpe, special
        self.clear()

    def clear(self) -> None:
        self.states: dict[tuple, State] = {}
        self.start = self._state("START", ROOT, "", 0)

    def _state(self, mode: str, bpe: Reach, last: str, gain: int) -> State:
        if mode not in ("SN", "A?"):
            gain, last = 0, ""
        key = (mode, bpe, last, gain)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.machine, found.mode, found.bpe, found.last, found.gain = self, mode, bpe, last, gain
            found.closing = self._unjoin(found) if mode == "A?" else 0
        return found

    def _unjoin(self, s: State) -> int:
        """Tokens added when an apostrophe and a letter turn out not to open a contraction but to be two splits."""
        return self.bpe.walk(ROOT, s.last)[1] - s.gain

    def _begin(self, char: str, kind: str, added: int) -> tuple[State, int]:
        mode = {"S": "S1", "W": "W1"}.get(kind, "A" if char == "'" else kind)
        return self._extend(ROOT, char, mode, added)

    def _extend(self, bpe: Reach, char: str, mode: str, added: int) -> tuple[State, int]:
        bpe, gain = self.bpe.walk(bpe, char)
        return self._state(mode, bpe, char, gain), added + gain

    def compile(self, s: State, char: str) -> tuple[State, int]:
        kind, mode = kind_of(char), s.mode
        blank = kind in "SW"
        if mode in ("L", "N", "O"):
            return self._extend(s.bpe, char, mode, 0) if kind == mode else self._begin(char, kind, 0)
        if mode == "S1":
            return self._extend(s.bpe, char, "SN" if blank else kind, 0)
        if mode == "W1":
            return self._extend(s.bpe, char, "SN", 0) if blank else self._begin(char, kind, 0)
        if mode == "SN":
            if blank:
                return self._extend(s.bpe, char, "SN", 0)
            # The last blank leaves the run: a space joins what follows, anything else stands alone.
            alone, gain = self.bpe.walk(ROOT, s.last)
            if s.last == " ":
                return self._extend(alone, char, kind, gain - s.gain)
            return self._begin(char, kind, gain - s.gain)
        if mode == "A":
            if char in _SHORT:
                return self._extend(s.bpe, char, "A?" if _SHORT[char] else "C", 0)
            return self._extend(s.bpe, char, "O", 0) if kind == "O" else self._begin(char, kind, 0)
        if mode == "A?":
            if char == _SHORT[s.last]:
                return self._extend(s.bpe, char, "C", 0)
            if kind == "L":
                return self._extend(self.bpe.walk(ROOT, s.last)[0], char, "L", s.closing)
            return self._begin(char, kind, s.closing)
        return self._begin(char, kind, 0)  # START, C

    def _plain(self, text: str) -> int:
        state, total = self.start, 0
        for begin in range(0, len(text), STRIDE):
            if len(self.states) > MAX_STATES:
                self.clear()  # but for the state it is in
                state = self.start if begin == 0 else self._state(state.mode, state.bpe, state.last, state.gain)
            for char in text[begin : begin + STRIDE]:
                state, added = state[char]
                total += added
        return total + state.closing

    def count(self, text: str) -> int:
        """Tokens of a text; each special string is one."""
        for literal in self.special:
            if literal in text:
                parts = text.split(literal)
                return len(parts) - 1 + sum(map(self.count, parts))
        return self._plain(text)


_LOADED: dict[str, Transducer] = {}


def load(path: str) -> Transducer:
    """The transducer of a tokenizer file, once per Python worker."""
    if path not in _LOADED:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = [t["content"] for t in spec["added_tokens"]]
        _LOADED[path] = Transducer(Bpe(spec["model"]["vocab"], spec["model"]["merges"]), special)
    return _LOADED[path]


#: A chunk's map: (head, tokens, tail), or (text, None, "") where nothing in it ends every split.
Map = tuple[str, int | None, str]


def _cuts(text: str) -> tuple[int, int]:
    """First and last place where white space follows something else, or (-1, -1)."""
    first = next((i for i in range(1, len(text)) if text[i] in SPACE and text[i - 1] not in SPACE), -1)
    if first < 0:
        return -1, -1
    return first, next(i for i in range(len(text) - 1, 0, -1) if text[i] in SPACE and text[i - 1] not in SPACE)


def chunk_map(machine: Transducer, text: str) -> Map:
    first, last = _cuts(text)
    if first < 0:
        return text, None, ""
    return text[:first], machine.count(text[first:last]), text[last:]


def compose(machine: Transducer, a: Map, b: Map) -> Map:
    if a[1] is None and b[1] is None:
        return a[0] + b[0], None, ""
    if a[1] is None:
        return a[0] + b[0], b[1], b[2]
    if b[1] is None:
        return a[0], a[1], a[2] + b[0]
    return a[0], a[1] + machine.count(a[2] + b[0]) + b[1], b[2]


def scan(machine: Transducer, maps: list[Map]) -> Map:
    """All maps in order as one, pairwise: the composition is associative."""
    while len(maps) > 1:
        maps = [compose(machine, *maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def total(machine: Transducer, m: Map) -> int:
    return machine.count(m[0]) if m[1] is None else machine.count(m[0]) + m[1] + machine.count(m[2])


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = LIMIT
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), one row per row of ``df``."""
    path = public_tokenizers.path(tokenizer)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        machine = load(path)
        return pd.Series([machine.count(t) for t in texts], dtype="int64")

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return pd.Series([[t[i : i + CHUNK] for i in range(0, len(t), CHUNK)] for t in texts], dtype=object)

    @F.pandas_udf("head string, tokens long, tail string")
    def summarise(chunks: pd.Series) -> pd.DataFrame:
        machine = load(path)
        out = pd.DataFrame([chunk_map(machine, c) for c in chunks], columns=["head", "tokens", "tail"])
        return out.astype({"tokens": "Int64"})

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        machine, pdf = load(path), pdf.sort_values("no")
        maps = [(h, None if pd.isna(n) else int(n), t) for h, n, t in zip(pdf["head"], pdf["tokens"], pdf["tail"])]
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "n_tokens": [total(machine, scan(machine, maps))]})

    texts = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))
    texts = texts.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = texts.filter(F.length("text") <= CHUNK).select("id", "n_bytes", count("text").alias("n_tokens"))
    # Rows of long texts are numbered once, in a written table, and their chunks dealt to all executors.
    long = texts.filter(F.length("text") > CHUNK).withColumn("row", F.monotonically_increasing_id())
    chunks = durable(long.select("row", "id", "n_bytes", F.posexplode(cut("text")).alias("no", "chunk")))
    maps = chunks.repartition("row", "no").select("row", "no", summarise("chunk").alias("m"))
    counts = maps.select("row", "no", "m.*").groupBy("row").applyInPandas(combine, "row long, n_tokens long")
    owners = chunks.filter("no = 0").select("row", "id", "n_bytes")
    whole = short.unionByName(owners.join(counts, "row").select("id", "n_bytes", "n_tokens"))
    return whole.withColumn("over_limit", F.col("n_tokens") > limit)
