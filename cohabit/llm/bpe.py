"""Byte-level BPE encoding and decoding (operator 12) over a pair occurrence index.

Map only.  Each task cuts its texts into words (the published pattern of byte-level BPE, as array operations on code points),
and merges the words that it has not met yet over a pair occurrence index (``pairindex``), many at a time; ids of a text are gathered from
those of its words.  The vocabulary is broadcast (its size is that of the tokenizer, not of the corpus).
Words met before are held up to ``HELD_WORDS``; beyond, a task forgets them, which changes nothing but the work.

Defined results: null texts give null ids and null decoded texts, empty texts none; repeated rows are encoded alike; a table without rows
gives none; a column of the output's name is replaced.  Strings of special tokens become their ids, as the library does, unless ``special=False``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import row_groups
from .common import free_name, mapped, without
from .pairindex import Merges, PairIndex
from .sentencepiece import _place, hash_codes

MODEL_PATH = "/opt/tokenizers/byte_bpe_50k.json"
#: Text bytes cut at once, and text bytes whose new words are merged together.
SLICE_BYTES, GROUP_BYTES = 1 << 19, 3 << 20
HELD_WORDS = 400_000

LETTER, NUMBER, BLANK, OTHER = range(4)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it prints, else the next one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def character_kinds() -> np.ndarray:
    """Of every code point: letter, number, white space, or anything else."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    kinds = np.full(0x110000, OTHER, dtype=np.int8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            lo, hi = (x if x < 0xD800 else x + 0x800 for x in (m.start(), m.end() - 1))
            kinds[lo : hi + 1] = kind
    kinds[0xD800:0xE000] = OTHER
    return kinds


@dataclass(frozen=True)
class ByteBPE:
    """A byte-level BPE tokenizer: merges, the ids of the bytes, the bytes of the ids, special tokens."""

    merges: Merges
    byte_ids: np.ndarray
    token_bytes: list[bytes]
    specials: dict[str, int]
    kinds: np.ndarray


def load(path: str = MODEL_PATH) -> ByteBPE:
    """Reads a tokenizer file on the driver (a vocabulary, so of bounded size)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or odd:
        raise ValueError("only byte-level BPE without a normaliser, a prefix space or options of the model is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError("only special tokens that match as they stand are supported")
    alphabet, vocab = byte_alphabet(), model["vocab"]
    pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    words = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for w, i in vocab.items():
        words[i] = bytes(alphabet[c] for c in w)
    for w, i in specials.items():
        words[i] = w.encode()
    byte_ids = np.zeros(256, dtype=np.int32)
    for c, b in alphabet.items():
        byte_ids[b] = vocab[c]
    return ByteBPE(Merges.build((vocab[a], vocab[b], k, vocab[a + b]) for k, (a, b) in enumerate(pairs)), byte_ids, words, specials, character_kinds())


def _is(codes: np.ndarray, at: np.ndarray, char: str) -> np.ndarray:
    return codes[np.minimum(at, len(codes) - 1)] == ord(char)


def word_cuts(codes: np.ndarray, edge: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words begin (and, at the end, one past the last); ``edge`` holds the places where a text begins or ends.

    Words are runs of letters, of numbers or of other signs, each with one space before it, and runs of white space; a
    run of white space leaves its last sign to what follows.  An apostrophe that begins a word takes s, t, m, d, re, ve or ll with it.
    """
    n = len(codes)
    kind = kinds[codes]
    cut = np.ones(n + 1, dtype=bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[edge] = True
    ends = np.zeros(n + 1, dtype=bool)
    ends[edge] = True
    run = np.flatnonzero(cut)
    start, end = run[:-1], run[1:]
    # the last white space before something in the same text
    open_ = (kind[start] == BLANK) & ~ends[end]
    last = end[open_] - 1
    cut[last] = True
    spaced = codes[last] == 32
    cut[last[spaced] + 1] = False
    # contractions
    lone = start[(kind[start] == OTHER) & (end - start == 1) & ~ends[end]]
    lone = lone[(codes[lone] == ord("'")) & cut[lone]]
    if len(lone):
        final = run[np.searchsorted(run, lone, "right") + 1]  # where the run after the apostrophe ends
        a, b = lone + 1, lone + 2
        two = (b < final) & ((_is(codes, a, "r") & _is(codes, b, "e")) | (_is(codes, a, "v") & _is(codes, b, "e")) | (_is(codes, a, "l") & _is(codes, b, "l")))
        one = np.isin(codes[a], [ord(c) for c in "stmd"])
        size = np.where(one, 1, np.where(two, 2, 0))
        took = size > 0
        cut[a[took]] = False
        cut[(lone + 1 + size)[took]] = True
    return cut


class Words:
    """Words of some texts: spans of the joined text, row by row, with their hashes and the distinct ones."""

    def __init__(self, texts: list[str | None], coder: ByteBPE, special: bool = True) -> None:
        rows, parts, fixed = [0], [], []
        pattern = "(" + "|".join(map(regex.escape, sorted(coder.specials, key=len, reverse=True))) + ")" if special and coder.specials else ""
        for t in texts:
            if t and pattern and any(s in t for s in coder.specials):
                for i, x in enumerate(regex.split(pattern, t)):
                    if i % 2:
                        fixed.append(len(parts))
                    parts.append(x)
            elif t:
                parts.append(t)
            rows.append(len(parts))
        self.text = "".join(parts)
        codes = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        edge = np.cumsum([0, *map(len, parts)])
        if len(codes):
            cut = word_cuts(codes, edge, coder.kinds)
            for i in fixed:
                cut[edge[i] + 1 : edge[i + 1]] = False
            at = np.flatnonzero(cut)
            self.start, self.end = at[:-1], at[1:]
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.at = np.searchsorted(self.start, edge[rows])
        self.which, self.known = pd.factorize(hash_codes(codes, self.start, self.end))
        self.first = np.zeros(len(self.known), dtype=np.int64)
        self.first[self.which[::-1]] = np.arange(len(self.which))[::-1]

    def distinct(self, chosen: np.ndarray) -> list[str]:
        k = self.first[chosen]
        return [self.text[a:b] for a, b in zip(self.start[k].tolist(), self.end[k].tolist(), strict=True)]


class Known:
    """Ids of the words that a task has met, by the words' hashes."""

    def __init__(self) -> None:
        self.hash, self.start, self.size, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def missing(self, hashes: np.ndarray) -> np.ndarray:
        return np.flatnonzero(_place(self.hash, hashes) < 0)

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.hash) + len(hashes) > HELD_WORDS:
            self.__init__()
        start = len(self.pool) + np.cumsum(sizes) - sizes
        every = np.concatenate((self.hash, hashes))
        order = np.argsort(every, kind="stable")
        self.hash, self.start, self.size = every[order], np.concatenate((self.start, start))[order], np.concatenate((self.size, sizes))[order]
        self.pool = np.concatenate((self.pool, ids.astype(np.int32)))

    def gather(self, hashes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in their order, and where each word's begin."""
        place = _place(self.hash, hashes)[which]
        size = self.size[place]
        ends = np.concatenate(([0], np.cumsum(size)))
        return self.pool[np.arange(ends[-1]) + np.repeat(self.start[place] - ends[:-1], size)], ends


class Encoder:
    """Encodes texts in one task."""

    def __init__(self, coder: ByteBPE, special: bool = True) -> None:
        self.coder, self.special, self.index, self.known = coder, special, PairIndex(coder.merges), Known()

    def words(self, texts: list[str | None]) -> Words:
        return Words(texts, self.coder, self.special)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the number of each."""
        fixed = self.coder.specials if self.special else {}
        raw = [b"" if w in fixed else w.encode() for w in words]
        at = np.cumsum([0, *map(len, raw)])
        ids, began = self.index.merge(self.coder.byte_ids[np.frombuffer(b"".join(raw), np.uint8)], at)
        sizes = np.diff(np.searchsorted(began, at))
        own = [i for i, w in enumerate(words) if w in fixed]
        if own:
            ids = np.insert(ids, np.searchsorted(began, at[own]), [fixed[words[i]] for i in own])
            sizes[own] = 1
        return ids, sizes

    def encode(self, groups: list[list[str | None]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list of texts: ids, and the place where each text's begin.  New words of all lists are merged together."""
        met, new, names = [], [], []
        for texts in groups:
            w = self.words(texts)
            k = self.known.missing(w.known)
            new.append(w.known[k])
            names += w.distinct(k)
            met.append((w.known, w.which.astype(np.int32), w.at))
        hashes, first = np.unique(np.concatenate([*new, np.zeros(0, np.uint64)]), return_index=True)
        if len(self.known.hash) + len(hashes) > HELD_WORDS and len(self.known.hash):  # words of these texts that would be forgotten are new again
            self.known = Known()
            yield from self.encode(groups)
            return
        if len(hashes):
            self.known.add(hashes, *self.merged([names[i] for i in first]))
        for known, which, at in met:
            ids, ends = self.known.gather(known, which)
            yield ids, ends[at]


def text_groups(batch: pa.RecordBatch, column: int) -> Iterator[list[tuple[pa.RecordBatch, list[str | None]]]]:
    """Slices of a batch with their texts, as many together as GROUP_BYTES allow."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    held, total = [], 0
    for lo, hi in row_groups(np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), SLICE_BYTES):
        part = batch.slice(lo, hi - lo)
        held.append((part, part.column(column).to_pylist()))
        total += int(sizes[lo:hi].sum())
        if total >= GROUP_BYTES:
            yield held
            held, total = [], 0
    if held:
        yield held


def decoded(ids: np.ndarray, token_bytes: list[bytes]) -> str:
    return b"".join(map(token_bytes.__getitem__, ids.tolist())).decode(errors="replace")


def encode(docs: DataFrame, coder: ByteBPE, text: str = "text", to: str = "ids", decoded_to: str | None = None, special: bool = True) -> DataFrame:
    """Adds ``to``, the ids of each text, and, if ``decoded_to`` names a column, the text that the ids decode to."""
    shared = docs.sparkSession.sparkContext.broadcast(coder)
    content = free_name(docs, "_content")
    plain = without(docs, to, *([decoded_to] if decoded_to else []))
    kept = len(plain.columns)
    out = plain.withColumn(to, F.lit(None).cast("array<int>"))
    out = out.withColumn(decoded_to, F.lit(None).cast("string")) if decoded_to else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value
        encoder = Encoder(coder, special)
        for b in batches:
            for group in text_groups(b, kept):
                for (part, texts), (ids, at) in zip(group, encoder.encode([t for _, t in group]), strict=True):
                    absent = pa.array([t is None for t in texts])
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()), mask=absent if None in texts else None)
                    more = [pa.array([None if t is None else decoded(ids[a:b], coder.token_bytes) for t, a, b in zip(texts, at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())] if decoded_to else []
                    yield pa.RecordBatch.from_arrays([*part.columns[:kept], lists, *more], names=names)

    names = out.columns
    return mapped(plain.withColumn(content, F.col(f"`{text}`").cast("string")), run, out.schema)


def decode(df: DataFrame, coder: ByteBPE, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text of the ids; null ids give null.  Bytes that are not UTF-8 become U+FFFD; ids outside the vocabulary give nothing."""
    shared = df.sparkSession.sparkContext.broadcast(coder.token_bytes)
    plain = without(df, to)
    place, names = plain.columns.index(ids), [*plain.columns, to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = [None if x is None else np.array([i for i in x if i is not None and 0 <= i < len(shared.value)], dtype=np.int64) for x in b.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if x is None else decoded(x, shared.value) for x in known], pa.string())], names=names)

    return mapped(plain, run, plain.withColumn(to, F.lit(None).cast("string")).schema)
