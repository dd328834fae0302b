"""BPE encoding and decoding by batched numpy merge rounds.

The words of a batch stand in one flat symbol array. Each round looks up the
rank of every adjacent pair by binary search over the sorted pair keys, takes
the lowest rank of each word and merges all its occurrences; words without a
mergeable pair leave the array. Distinct chunks of a batch are merged once and
their ids are gathered back into document order.

Results equal the tokenizers library's for a word-level BPE file: lower case,
NFC, white space dropped, special tokens recognised in the raw text, unused
truncation and padding.

Defined cases: null text counts as empty (no ids, empty decoded text); texts of
any length are cut only at white space and never truncated; repeated rows give
repeated results; an empty table gives an empty result; columns other than the
id and the text are ignored, whatever their names; null ids pass through.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailframe.llm._text import LONG, SPACE, pack, ragged_take, read, same_spans, slices, span_hashes, spans, utf8, word_codes

#: The split pattern that the vocabulary file declares, with its \s read as the Unicode property.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
MAX_MODEL_BYTES = 64 << 20
CACHE_BYTES = 64 << 20
#: Bytes of a word beyond which the merge rounds of numpy give way to the library.
LONG_WORD = 1 << 14
_NONE = np.int32(2**31 - 1)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def model_bytes(path: str | None = None) -> bytes:
    """The vocabulary file, read on the driver; refused beyond a fixed size since it is broadcast."""
    with open(path or default_model(), "rb") as f:
        raw = f.read(MAX_MODEL_BYTES + 1)
    if len(raw) > MAX_MODEL_BYTES:
        raise ValueError(f"vocabulary file over {MAX_MODEL_BYTES} bytes")
    return raw


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@cache
def _unassigned() -> np.ndarray:
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def odd(text: str) -> bool:
    """Whether a code point isn't assigned in Python's Unicode version; other versions may split and fold it otherwise."""
    return not text.isascii() and bool(_unassigned()[np.frombuffer(text.encode("utf-32-le"), "<u4")].any())


class WordBpe:
    """A loaded vocabulary; merge_words and ids are exact for every input."""

    def __init__(self, raw: bytes) -> None:
        spec = json.loads(raw)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = vocab | self.special
        self.size = max(names.values()) + 1
        self.tokens: list[str] = [""] * self.size
        for token, i in names.items():
            self.tokens[i] = token
        symbols = byte_symbols()
        self.symbols = symbols
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.final = np.array([vocab[c + suffix] for c in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.rank_of = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.raw = raw
        self.split = regex.compile(r"\n|" + SPLIT)
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        text = [(t + " ").encode() for t in self.tokens]
        self.text = np.frombuffer(b"".join(text), np.uint8)
        self.text_off = np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64)

    def all_pieces(self, chunks: list[str]) -> tuple[list[str | int], np.ndarray]:
        """Words of chunks without ASCII white space, split at once; special tokens are ids. The number of each chunk's words."""
        joined = "\n".join(chunks)
        if "<|" not in joined and not odd(joined):
            flat = self.split.findall(self.plain(joined))
            at = np.array([i for i, p in enumerate(flat) if p == "\n"], np.int64)
            counts = np.diff(np.concatenate([[-1], at, [len(flat)]])) - 1
            return [p for p in flat if p != "\n"], counts
        out: list[str | int] = []
        counts = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            before = len(out)
            out.extend(self.pieces(chunk))
            counts[k] = len(out) - before
        return out, counts

    def pieces(self, chunk: str) -> list[str | int]:
        """Words of one chunk; a special token is its id. Code points that this Python doesn't know go to the library."""
        if odd(chunk):
            return list(self.library.encode(chunk, add_special_tokens=False).ids)
        out: list[str | int] = []
        parts = self.special_split.split(chunk) if self.special_split and "<|" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                out.extend(self.split.findall(self.plain(part)))
        return out

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        library = Tokenizer.from_buffer(self.raw)
        library.no_truncation()
        library.no_padding()
        return library

    @staticmethod
    def plain(text: str) -> str:
        """NFC, then each character's lower case (the final sigma has none of its own)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], _NONE)

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words as one ragged array; a word of more than LONG_WORD bytes would take too many rounds and goes to the library."""
        words = [w.encode() for w in words]
        huge = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if huge:
            rest, runs = self._merge([w for w in words if len(w) <= LONG_WORD])
            own = iter(np.split(rest, runs[1:-1]) if len(runs) > 1 else [])
            parts = [np.array(self.library.encode(w.decode(), add_special_tokens=False).ids) if len(w) > LONG_WORD else next(own) for w in words]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._merge(words)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not words:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        length = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(length)
        symbol = self.inner[raw]
        symbol[ends - 1] = self.final[raw[ends - 1]]
        word = np.repeat(np.arange(len(words)), length)
        rank = np.full(len(symbol), _NONE, np.int32)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner] = self.ranks(symbol[inner], symbol[inner + 1])
        done_word, done_id = [], []
        while len(symbol):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            lowest = np.repeat(np.minimum.reduceat(rank, first), size)
            over = lowest == _NONE
            if over.any():
                done_word.append(word[over])
                done_id.append(symbol[over])
                keep = ~over
                symbol, word, rank, lowest = symbol[keep], word[keep], rank[keep], lowest[keep]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == lowest)
            # in a run of overlapping equal pairs (a a a) every second one merges, from the left
            start = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run = np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            symbol[at] = self.merged[rank[at]]
            gone = np.zeros(len(symbol), bool)
            gone[at + 1] = True
            moved = at - np.arange(len(at))  # places after the removal
            keep = ~gone
            symbol, word, rank = symbol[keep], word[keep], rank[keep]
            again = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            rank[again] = _NONE
            again = again[again < len(symbol) - 1]
            again = again[word[again] == word[again + 1]]
            rank[again] = self.ranks(symbol[again], symbol[again + 1])
        if not done_word:
            return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
        owner = np.concatenate(done_word)
        order = np.argsort(owner, kind="stable")
        offsets = np.searchsorted(owner[order], np.arange(len(words) + 1))
        return np.concatenate(done_id)[order], offsets

    def text_of(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded text of each run: token strings joined by one space."""
        if not len(ids):
            return np.zeros(0, np.uint8), np.zeros(len(offsets), np.int64)
        data, at = ragged_take(self.text, self.text_off, ids)
        begin, end = at[offsets[:-1]], at[offsets[1:]]
        keep = np.ones(len(data), bool)
        full = end > begin
        keep[end[full] - 1] = False
        return data[keep], np.concatenate([[0], np.cumsum(end - begin - full)])


class _Ragged:
    """A ragged array that grows by doubling, so that appending costs no copy of the whole each time."""

    def __init__(self, kind: type) -> None:
        self.data, self.off, self.n = np.zeros(1024, kind), np.zeros(1024, np.int64), 0

    def used(self) -> int:
        return int(self.off[self.n])

    def extend(self, values: np.ndarray, offsets: np.ndarray) -> None:
        end, n = self.used(), self.n + len(offsets) - 1
        for name, size in (("data", end + len(values)), ("off", n + 1)):
            old = getattr(self, name)
            if size > len(old):
                setattr(self, name, np.concatenate([old, np.zeros(max(size, 2 * len(old)) - len(old), old.dtype)]))
        self.data[end : end + len(values)] = values
        self.off[self.n + 1 : n + 1] = end + offsets[1:]
        self.n = n

    def shrink(self, n: int) -> None:
        self.n = n


class ChunkEncoder:
    """Encodes documents by their distinct chunks, with a cache of at most CACHE_BYTES (and one slice's chunks) that outlives a batch.

    Hashes only find chunks; a chunk's ids are taken from the cache after its bytes were compared.
    Chunks of more than LONG bytes aren't kept.
    """

    def __init__(self, model: WordBpe, merge=None) -> None:
        self.model, self.merge = model, merge or model.merge_words
        self.clear()

    def clear(self) -> None:
        self.hash, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.ids = _Ragged(np.uint8), _Ragged(np.int32)

    def bytes(self) -> int:
        """Of all that is kept: hashes, places, texts, ids and their offsets."""
        return 32 * len(self.hash) + self.text.used() + 4 * self.ids.used()

    def _new(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks as one ragged array."""
        gc.disable()  # very many small objects, and no cycles among them
        try:
            return self._encoded([c.decode("utf-8", "replace") for c in chunks])
        finally:
            gc.enable()

    def _encoded(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces, counts = self.model.all_pieces(chunks)
        index: dict[str | int, int] = {}
        at = np.array([index.setdefault(p, len(index)) for p in pieces], np.int64)
        words = [p for p in index if isinstance(p, str)]
        ids, offsets = self.merge(words) if words else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        if len(words) < len(index):  # runs of one id after the words' own
            extra = [p for p in index if not isinstance(p, str)]
            ids, offsets = np.concatenate([ids, extra]), np.concatenate([offsets, offsets[-1] + 1 + np.arange(len(extra))])
            place, texts, others = np.zeros(len(index), np.int64), 0, 0
            for i, p in enumerate(index):
                if isinstance(p, str):
                    place[i], texts = texts, texts + 1
                else:
                    place[i], others = len(words) + others, others + 1
            at = place[at]
        out, runs = ragged_take(ids, offsets, at)
        return out.astype(np.int32), runs[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Cache places of distinct chunks: -1 if not there, -2 if another text has the hash."""
        if not len(self.hash):
            return np.full(len(hashes), -1)
        order = np.argsort(hashes)
        at = np.empty(len(hashes), np.int64)
        at[order] = np.minimum(np.searchsorted(self.hash, hashes[order]), len(self.hash) - 1)  # sorted needles stay near each other
        place = np.where(self.hash[at] == hashes, self.place[at], -1)
        hit = np.flatnonzero(place >= 0)
        same = same_spans(data, starts[hit], ends[hit], self.text.data[: self.text.used()], self.text.off[place[hit]], self.text.off[place[hit] + 1])
        place[hit[~same]] = -2
        return place

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each row as one ragged array."""
        starts, ends, rows = spans(data, offsets, ~SPACE)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        code, first = word_codes(data, starts, ends)
        begin, end = starts[first], ends[first]
        hashes = span_hashes(data, begin, end)
        place = self._known(data, begin, end, hashes)
        fresh = (end - begin)[(place == -1) & (end - begin <= LONG)]
        if len(self.hash) and self.bytes() + 32 * len(fresh) + 5 * int(fresh.sum()) > CACHE_BYTES:  # a byte makes one id at most
            self.clear()
            place[:] = -1
        _, once = np.unique(hashes, return_index=True)  # of chunks that share a hash only one is kept
        keep = np.zeros(len(hashes), bool)
        keep[once] = True
        keep &= (place == -1) & (end - begin <= LONG)
        loose = np.flatnonzero((place < 0) & ~keep)
        keep = np.flatnonzero(keep)
        raw = data.tobytes()
        new = np.concatenate([keep, loose])
        known = self.ids.n
        if len(new):
            place[new] = known + np.arange(len(new))
            self.ids.extend(*self._new([raw[s:e] for s, e in zip(begin[new].tolist(), end[new].tolist())]))
        out, out_runs = ragged_take(self.ids.data, self.ids.off, place[code])
        self.ids.shrink(known + len(keep))
        if len(keep):
            order = keep[np.argsort(hashes[keep])]
            where = np.searchsorted(self.hash, hashes[order])
            self.hash, self.place = np.insert(self.hash, where, hashes[order]), np.insert(self.place, where, place[order])
            bound = np.zeros(2 * len(keep), np.int64)
            bound[::2], bound[1::2] = begin[keep], end[keep]
            self.text.extend(*ragged_take(data, bound, np.arange(0, 2 * len(keep), 2)))
        return out, out_runs[rows]


_LOADED: dict[tuple[int, str], ChunkEncoder] = {}


def encoder(raw: bytes, kind: str = "numpy") -> ChunkEncoder:
    """The worker's encoder for a vocabulary, loaded once in each process."""
    key = (hash(raw), kind)
    if key not in _LOADED:
        model = WordBpe(raw)
        merge = None
        if kind == "library":
            merge = library_merge(raw, model)
        _LOADED[key] = ChunkEncoder(model, merge)
    return _LOADED[key]


def library_merge(raw: bytes, model: WordBpe):
    """Word ids by the tokenizers library's own model."""
    from tokenizers import Tokenizer

    inner = Tokenizer.from_buffer(raw).model
    table = {b: c for b, c in enumerate(model.symbols) if b != 0x0A}  # no word holds a newline

    def merge(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids: list[int] = []
        ends = [0]
        for word in "\n".join(words).encode().decode("latin-1").translate(table).split("\n"):
            ids += [t.id for t in inner.tokenize(word)]
            ends.append(len(ids))
        return np.array(ids, np.int64), np.array(ends, np.int64)

    return merge


def encode_decode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, decode: bool = True) -> DataFrame:
    """Rows (id, n_tokens long, ids binary of little-endian uint32, decoded string if asked)."""
    spark: SparkSession = df.sparkSession
    raw = spark.sparkContext.broadcast(model_bytes(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(raw.value)
        for part in slices(batches, "t"):
            ids, offsets = own.encode(*utf8(part.column(1)))
            out = [part.column(0), pa.array(np.diff(offsets), pa.int64()), pack(ids.astype("<u4").view(np.uint8), offsets * 4, pa.large_binary()).cast(pa.binary())]
            if decode:
                out.append(decode_ids(own.model, out[2]))
            yield pa.RecordBatch.from_arrays(out, names=["k", "n_tokens", "ids", "decoded"][: len(out)])

    source = df.select(df[id_col].alias("k"), df[text_col].cast("string").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    out = source.mapInArrow(run, f"k {kind}, n_tokens bigint, ids binary" + ", decoded string" * decode)
    return out.withColumnRenamed("k", id_col)


def decode_ids(model: WordBpe, column: pa.Array) -> pa.Array:
    """Texts of a binary column of little-endian uint32 ids; special tokens are kept."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    text, runs = model.text_of(data.view("<u4").astype(np.int64), (off - off[0]) // 4)
    return pack(text, runs, pa.large_string()).cast(pa.string())


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
