"""SentencePiece encoding and decoding with byte offsets into the original text.

The model file is read here: its pieces, scores and the compiled character map of its normaliser. A text is normalised by
longest-prefix matches in that map, which record for every normalised byte the original byte it came from; so each piece
knows the span of the original it stands for, whatever the normaliser did. Pieces are merged by score, leftmost first
(pair by pair in short words, by the left-to-right automaton of ``bpe_automaton`` in long ones).

No piece of the model holds a word mark after another character, so words are encoded apart and a word that was seen before
costs one dictionary look-up, and a long text is encoded stretch by stretch; a model for which that is not so is encoded whole. Ids, spans and decoded text of a batch are
gathered from the words' in numpy.

Defined results: null text counts as empty and gives the end id alone; one output row per input row, repeated rows and null
ids included; an empty table gives an empty table; other columns are ignored. Characters without a piece become byte pieces:
the last of them bears the character's span, the ones before are empty at its start.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchlake.llm.bpe_automaton import LastTokens
from pitchlake.llm.storage import tidy

MARK = "▁"
WHOLE = "(?s).+"
#: Words and compiled states kept at a time, in each Python worker; original bytes of one Arrow batch.
MAX_WORDS = 250_000
MAX_STATES = 50_000
BATCH_BYTES = 1 << 20
#: Characters up to which a word's pieces are merged pair by pair; a longer stretch goes through the automaton, in linear time.
SHORT = 24
#: Characters of a text that are encoded at a time, where the model lets it be cut between words.
STRETCH = 1 << 19
# Kinds of pieces and the model type in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message; fixed 32-bit values stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = buf[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(buf):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            size = varint() if size is None else size
            yield tag >> 3, buf[at : at + size]
            at += size


class CharMap:
    """A compiled character map: a double-array trie of byte prefixes, and the strings they turn into."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size :]
        self.heads = {b for b in range(256) if self.units and self._child(self._base(0), b) is not None}

    def _base(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def _child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes]:
        """(bytes matched, what they turn into) for the longest key that starts at ``at``; (0, b"") if there is none."""
        base, found = self._base(0), (0, b"")
        for n in range(at, len(data)):
            node = self._child(base, data[n])
            if node is None:
                break
            base = self._base(node)
            if self.units[node] >> 8 & 1:
                start = self.units[base] & 0x7FFFFFFF
                found = (n + 1 - at, self.strings[start : self.strings.index(b"\0", start)])
        return found


class State(dict):
    """A state of the left-to-right encoder: character -> (next state, last piece), compiled when first needed."""

    __slots__ = ("codec", "suffix", "lasts")

    def __missing__(self, char: str):
        found = self[char] = self.codec.compile(self, char)
        return found


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            fields = list(_fields(f.read()))
        pieces = [dict(_fields(v)) for k, v in fields if k == 1]
        trainer = dict(_fields(next(v for k, v in fields if k == 2)))
        spec = dict(_fields(next(v for k, v in fields if k == 3)))
        if trainer.get(3, 1) != BPE or trainer.get(24, 0) or any(p.get(3, NORMAL) in (USER_DEFINED, UNUSED) for p in pieces):
            raise ValueError("only BPE models with word marks in front and without user-defined pieces are supported")
        self.pieces = [p[1].decode() for p in pieces]
        self.kinds = [p.get(3, NORMAL) for p in pieces]
        score = [struct.unpack("<f", p.get(2, b"\0\0\0\0"))[0] for p in pieces]
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.rank = {p: (-score[i]) for p, i in self.ids.items() if len(p) > 1}
        self.bytes = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.unknown = self.kinds.index(UNKNOWN)
        self.end = self.pieces.index("</s>")
        self.charmap = CharMap(spec.get(2, b""))
        self.prefix, self.squeeze, self.mark_spaces = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.word = self._word_pattern()
        self.last = LastTokens([p for p in self.ids], self._greedy)
        self._tables()
        self._forget_states()
        self._forget_words()

    def _forget_states(self) -> None:
        self.states: dict[tuple, State] = {}
        self.root = self._state("", (None,))

    def _forget_words(self) -> None:
        self.codes: dict[str, int] = {}
        self.starts, self.sizes, self.flat = array("q"), array("q"), array("i")

    def _word_pattern(self) -> re.Pattern:
        """Stretches that no piece reaches across: each kind of character apart where the pieces allow it, whatever the
        text; marks go with what follows them."""
        if not self.mark_spaces or any(re.search(f"[^{MARK}]{MARK}", p) for p in self.rank):
            return re.compile(WHOLE)
        inner = {c for p in self.rank for c in p}
        lone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inner)
        letter = re.compile(r"[^\W\d_]")
        mixed = any(
            bool(letter.match(a)) != bool(letter.match(b)) for p in self.rank for a, b in zip(p, p[1:]) if MARK not in (a, b)
        )
        if mixed:
            kinds = [f"{MARK}*[^{MARK}{lone}]+"]
        else:
            kinds = [rf"{MARK}*[^\W\d_]+", rf"{MARK}*(?:(?![^\W\d_])[^{MARK}{lone}])+"]
        kinds += [f"{MARK}+"] + ([f"[{lone}]"] if lone else [])
        return re.compile("|".join(kinds))

    # -- normalisation -------------------------------------------------------------------------------------------------

    def normalize(self, text: str, first: bool = True) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes and its end the offset of the original byte it stands for.
        A stretch that is not the first of its text gets no mark in front."""
        data = text.encode()
        raw = np.frombuffer(data, dtype=np.uint8)
        mark = MARK if self.mark_spaces else " "
        width = len(mark.encode())
        if not self.squeeze and self.charmap.heads.isdisjoint(data if len(data) < 4096 else set(data)):
            out = text.replace(" ", mark)
            places = np.repeat(np.arange(len(raw)), np.where(raw == 32, width, 1))
        else:
            out, places = self._mapped(data, mark)
        if self.prefix and first and out:
            out, places = mark + out, np.concatenate([np.full(width, places[0] if len(places) else 0), places])
        return out, np.append(places, len(raw))

    def _mapped(self, data: bytes, mark: str) -> tuple[str, np.ndarray]:
        """By the character map, squeezing white space if the model says so."""
        parts: list[tuple[bytes, int]] = []
        at = 0
        while at < len(data):
            size, new = self.charmap.longest(data, at) if data[at] in self.charmap.heads else (0, b"")
            if not size:
                lead = data[at]
                size = 1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4
                new = data[at : at + size]
            parts.append((new, at))
            at += size
        out, places, blank = bytearray(), [], self.squeeze
        wide = mark.encode()
        for new, at in parts:
            for byte in new:
                if byte == 32 and self.squeeze and blank:
                    continue
                blank = byte == 32
                got = wide if blank else bytes((byte,))
                out += got
                places += [at] * len(got)
        if self.squeeze and out.endswith(wide):
            del out[-len(wide) :], places[-len(wide) :]
        return out.decode(), np.array(places, dtype=np.int64)

    # -- words ---------------------------------------------------------------------------------------------------------

    def _state(self, suffix: str, lasts: tuple) -> State:
        key = (suffix, lasts)
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.codec, found.suffix, found.lasts = self, suffix, lasts
        return found

    def compile(self, state: State, char: str) -> tuple[State, tuple[int, int | None]]:
        token, _, suffix, lasts, _ = self.last.extend(state.suffix, state.lasts, char)
        return self._state(suffix, lasts), (len(token), self.ids.get(token))

    def merge(self, word: str) -> list[tuple[int, int | None]]:
        """(length, id) of a word's pieces, as merging the best-scored pair first, the leftmost of equals, makes them; no id
        for a character that is no piece."""
        if len(word) <= SHORT:
            return [(len(piece), self.ids.get(piece)) for piece in self._greedy(word)]
        state, ends = self.root, []
        for char in word:
            state, token = state[char]
            ends.append(token)
        at, parts = len(word), []
        while at:
            token = ends[at - 1]
            parts.append(token)
            at -= token[0]
        parts.reverse()
        return parts

    def _greedy(self, text: str) -> list[str]:
        """The same by merging pair after pair, for a short stretch."""
        parts, get, none = list(text), self.rank.get, np.inf
        scores = [get(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores:
            low = min(scores)
            if low == none:
                break
            at = scores.index(low)
            joined = parts[at] + parts[at + 1]
            parts[at : at + 2] = [joined]
            del scores[at]
            if at:
                scores[at - 1] = get(parts[at - 1] + joined, none)
            if at < len(scores):
                scores[at] = get(joined + parts[at + 1], none)
        return parts

    def _encode_word(self, word: str) -> int:
        parts = self.merge(word)
        ids = [i for _, i in parts]
        if None in ids:
            ids = self._by_bytes(word, parts)
        self.starts.append(len(self.flat))
        self.sizes.append(len(ids))
        self.flat.extend(ids)
        code = self.codes[word] = len(self.sizes) - 1
        return code

    def _by_bytes(self, word: str, parts: list[tuple[int, int | None]]) -> list[int]:
        """Ids where some part is no piece."""
        ids, at = [], 0
        for size, known in parts:
            if known is None and self.bytes:
                ids += [self.bytes[b] for b in word[at : at + size].encode()]
            else:
                ids.append(self.unknown if known is None else known)
            at += size
        return ids

    def decode(self, ids) -> str:
        """Text of a whole document's ids: marks are spaces, byte pieces bytes, control pieces nothing, and the space that
        the encoder put in front goes."""
        text = self._bytes_of(np.asarray(ids, dtype=np.int64))[0].tobytes().decode(errors="replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def _tables(self) -> None:
        """What each id stands for in bytes, side by side, and the value of byte pieces (-1 for others)."""
        shown = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == BYTE:
                shown.append(bytes((int(piece[3:5], 16),)))
            elif kind == NORMAL:
                shown.append(piece.replace(MARK, " ").encode())
            else:
                shown.append(" ⁇ ".encode() if kind == UNKNOWN else b"")
        self.shown = np.frombuffer(b"".join(shown), dtype=np.uint8)
        self.shown_size = np.array([len(x) for x in shown], dtype=np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.piece_size = np.array([len(p.encode()) for p in self.pieces], dtype=np.int64)
        self.byte_value = np.array([x[0] if k == BYTE else -1 for x, k in zip(shown, self.kinds)], dtype=np.int64)

    def _bytes_of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes of ids, and how many each id has."""
        sizes = self.shown_size[ids]
        ahead = np.cumsum(sizes) - sizes
        return self.shown[np.repeat(self.shown_start[ids] - ahead, sizes) + np.arange(int(sizes.sum()))], sizes

    def _widths(self, ids: np.ndarray) -> np.ndarray:
        """Normalised bytes that each id covers: of the byte pieces of a character, the last covers them all."""
        value, widths = self.byte_value[ids], self.piece_size[ids]
        if (value < 0).all():
            return widths
        opens = (value < 128) | (value >= 192)
        char = np.cumsum(opens)
        last = np.append(char[1:] != char[:-1], True)
        covered = np.bincount(char)[char]
        return np.where(value < 0, widths, np.where(last, covered, 0))

    # -- batches -------------------------------------------------------------------------------------------------------

    def stretches(self, text: str) -> list[str]:
        """A text in stretches of about ``STRETCH`` characters that are encoded apart: cut before a space that follows another
        character, where the model's words end and, without a character map, so does all normalisation."""
        if self.squeeze or self.charmap.heads or self.word.pattern == WHOLE:
            return [text]
        out, start = [], 0
        while len(text) - start > STRETCH:
            at = start + STRETCH
            while (at := text.find(" ", at)) > 0 and text[at - 1] == " ":
                at += 1
            if at < 0:
                break
            out.append(text[start:at])
            start = at
        return [*out, text[start:]]

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """The same as ``encode_batch``, a long text stretch by stretch."""
        if max(map(len, texts), default=0) <= STRETCH:
            return self.encode_batch(texts)
        sizes, parts, decoded = [], [], []
        for text in texts:
            offset, size, shown = 0, 0, []
            cut = self.stretches(text)
            for n, stretch in enumerate(cut):
                _, ids, begins, ends, said = self.encode_batch([stretch], n == 0)
                inner = slice(None) if n == len(cut) - 1 else slice(-1)
                parts.append((ids[inner], begins[inner] + offset, ends[inner] + offset))
                size += len(parts[-1][0])
                shown += said
                offset += len(stretch.encode())
            sizes.append(size)
            decoded.append("".join(shown))
        return (np.append(0, np.cumsum(sizes)), *(np.concatenate(x) for x in zip(*parts)), decoded)

    def encode_batch(self, texts: list[str], first: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """(offsets of the rows, ids, begins, ends, decoded texts); each row's last id is the end id, with an empty span."""
        if len(self.codes) > MAX_WORDS:
            self._forget_words()
        if len(self.states) > MAX_STATES:
            self._forget_states()
        known, codes, n_words, aligned = self.codes, [], [], []
        for text in texts:
            norm, places = self.normalize(text, first)
            row = [known[w] if w in known else self._encode_word(w) for w in self.word.findall(norm)]
            codes += row
            n_words.append(len(row))
            aligned.append(places)
        # From here on all rows at once: words to ids, ids to widths, widths to places in each row's own alignment.
        words = np.array(codes, dtype=np.int64)
        n = np.array(self.sizes, dtype=np.int64)[words]
        ahead = np.cumsum(n) - n
        index = np.repeat(np.array(self.starts, dtype=np.int64)[words] - ahead, n) + np.arange(int(n.sum()))
        ids = np.array(self.flat, dtype=np.int32)[index]
        upto = np.append(0, np.cumsum(n))[np.append(0, np.cumsum(np.array(n_words, dtype=np.int64)))]
        row_of = np.repeat(np.arange(len(texts)), np.diff(upto))
        ends = np.cumsum(self._widths(ids))
        bases = np.append(0, ends)[upto]
        lengths = np.array([len(p) for p in aligned], dtype=np.int64)
        heads = np.cumsum(lengths) - lengths
        places = np.concatenate(aligned) if aligned else np.zeros(0, np.int64)
        shift = (heads - bases[:-1])[row_of]
        begins, ends = places[np.append(0, ends)[:-1] + shift], places[ends + shift]
        shown, sizes = self._bytes_of(ids)
        cuts = np.append(0, np.cumsum(sizes))[upto].tolist()
        raw = shown.tobytes()
        decoded = [raw[a:b].decode(errors="replace") for a, b in zip(cuts, cuts[1:])]
        if self.prefix and first:
            decoded = [t[1:] if t.startswith(" ") else t for t in decoded]
        # The end id closes every row, with an empty span at the end of the text.
        closing = places[heads + lengths - 1]
        ids, begins, ends = (np.insert(x, upto[1:], y) for x, y in ((ids, np.int32(self.end)), (begins, closing), (ends, closing)))
        return upto + np.arange(len(texts) + 1), ids, begins, ends, decoded


_LOADED: dict[str, Codec] = {}


def load(path: str) -> Codec:
    """The codec of a model file, once per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Codec(path)
    return _LOADED[path]


def encode_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "piece_bpe_32k.model"
) -> DataFrame:
    """(id, ids array<int>, begins array<int>, ends array<int>, decoded), the end id last."""
    path = public_tokenizers.path(tokenizer)
    texts = df.select(df[id_col].alias("id"), F.coalesce(df[text_col], F.lit("")).alias("text"))

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.astype(np.int32)))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load(path)
        for batch in batches:
            size = pa.compute.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(size)]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                # Copies that follow one another, as a mix makes them, are encoded once.
                texts = part.column(1).dictionary_encode()
                offsets, ids, begins, ends, decoded = codec.encode_texts(texts.dictionary.to_pylist())
                columns = [lists(offsets, ids), lists(offsets, begins), lists(offsets, ends), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(c.take(texts.indices) for c in columns)], ["id", "ids", "begins", "ends", "decoded"]
                )

    id_type = df.schema[id_col].dataType.simpleString()
    return texts.mapInArrow(tidy(encode), f"id {id_type}, ids array<int>, begins array<int>, ends array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of encoded documents."""
    return encoded.select(
        "id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
