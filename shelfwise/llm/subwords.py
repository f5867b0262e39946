"""Public tokenizers inside tasks: ids of whole texts, by chunks that are kept.

A text is cut where a tokenizer is sure to cut it, each new chunk is encoded by
the tokenizer's library and kept, and a text's ids are its chunks' ids in order:
texts repeat their words, so most chunks are looked up.

Where a chunk may end: after a character that is no white space, before an ASCII
white space character.  The byte-level pre-tokenizer never joins these two.  The
piece model does not either if no piece has a white space mark after another
character, and none of several characters holds ASCII white space; that is read
off the model when it is loaded.  Texts with a white space character beyond ASCII
before an ASCII one are encoded whole by the byte-level tokenizer.
"""

from __future__ import annotations

import functools
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

# White space that is not ASCII, in UTF-8, before white space that is.
ODD = re.compile(
    rb"(?:\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)[\t-\r ]"
)
WIDE = re.compile(r"[\x85\xa0\u1680\u180e\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Characters whose class may differ between Unicode versions of two libraries.
BEYOND = re.compile(r"[^\x00-\u024f\u2010-\u2027]")
# Fixed value: how byte-level vocabularies split a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK = re.compile(rb"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+")
RUN = 200  # new chunks that are encoded as one text
JOINED = 32  # the same for a piece model
KEPT = 160 << 20  # bytes of chunks and ids that a process keeps; beyond that it starts anew
ENTRY = 200  # bytes that one of them takes besides
TABLE = 64 << 20  # bytes of a table of chunks and ids, which takes some 30 a chunk


def located(path: str) -> str:
    """A file's place: a bare name is one of the installed public tokenizers."""
    if "/" in path:
        return path
    import public_tokenizers

    return public_tokenizers.path(path)


def single(text: bytes) -> bool:
    """Whether ASCII white space in a text is single spaces and line feeds."""
    return not any(c in text for c in (b"  ", b"\n\n", b"\n ", b" \n", b"\t", b"\r", b"\x0b", b"\x0c"))


def keys(text: bytes) -> list[bytes]:
    """The chunks of a text, each named by a key; `literal` gives a key's bytes.

    Single spaces are the rule, so a key stands for itself after one space; a key
    that begins with a line feed is itself, one that begins with a space the rest.
    """
    if single(text):
        found = text.replace(b"\n", b" \n").split(b" ")
        # Before the first space no space was: an empty first key came from the split.
        if not found[0]:
            del found[0]
        elif found[0][:1] != b"\n":
            found[0] = b" " + found[0]
        return found
    return [
        c if c[:1] == b"\n" else b" " + c if c[:1] != b" " or c[1:2] in (b" ", b"\n") else c[1:]
        for c in CHUNK.findall(text)
    ]


def literal(key: bytes) -> bytes:
    if key[:1] == b"\n":
        return key
    return key[1:] if key[:1] == b" " else b" " + key


class Kept(dict):
    """What a process has found for chunks, up to ``limit`` bytes of it."""

    def __init__(self, limit: int = KEPT):
        super().__init__()
        self.size, self.limit = 0, limit

    def missing(self, parts: list[list[bytes]]) -> list[bytes]:
        """Chunks of ``parts`` that are not here; a full store is emptied first."""
        if self.size > self.limit:
            self.clear()
            self.size = 0
        return list(set().union(*parts).difference(self))

    def add(self, new: list[bytes], found: list) -> None:
        self.update(zip(new, found, strict=True))
        self.size += ENTRY * len(new) + 3 * sum(map(len, new))


class Table:
    """What a process has found for chunks, up to ``limit`` bytes of it, in Arrow and numpy: a few bytes a chunk.

    The ids of chunk i are ``sizes[i]`` ids from ``starts[i]`` on.
    """

    def __init__(self, limit: int = TABLE):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.names, self.ids = pa.array([], pa.binary()), b""
        self.sizes = self.starts = np.zeros(0, np.int64)

    def places(self, names: pa.BinaryArray) -> pa.Int32Array:
        """The place of each name; null where it is not here.  A full table is emptied first."""
        if self.names.nbytes + len(self.ids) + self.sizes.nbytes + self.starts.nbytes > self.limit:
            self.clear()
        return pc.index_in(names, value_set=self.names)

    def add(self, new: pa.BinaryArray, sizes: np.ndarray, ids: bytes) -> int:
        """Keep the chunks ``new``; returns the place of the first."""
        first = len(self.names)
        self.names, self.ids = pa.concat_arrays([self.names, new]), self.ids + ids
        self.sizes = np.concatenate([self.sizes, sizes])
        self.starts = np.cumsum(self.sizes) - self.sizes
        return first


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes are themselves, others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)).difference(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def packed(ids: list[int] | np.ndarray, dtype) -> bytes:
    return np.asarray(ids, dtype).tobytes()


def sliced(ids: bytes, ends: np.ndarray, dtype: np.dtype) -> list[bytes]:
    """Packed ids cut after the given numbers of ids."""
    at = (ends * dtype.itemsize).tolist()
    return [ids[i:j] for i, j in zip([0, *at[:-1]], at, strict=True)] if at else []


def _strings(column: pa.BinaryArray) -> list[bytes]:
    """The values of a column without nulls, cut out of its buffer at once."""
    _, offsets, data = column.buffers()
    if not len(column):
        return []
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].tolist()
    text = data.to_pybytes() if data else b""
    return [text[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


class ByteLevel:
    """A byte-level tokenizer of the tokenizers library; ids are packed little-endian."""

    def __init__(self, path: str, special: bool, ranks: bool = False):
        """``special``: whether special tokens' strings inside a text are those tokens.

        ``ranks``: have tiktoken merge chunks of Latin text, several times as fast, if
        the file's merges are in the order of its ids, so that both give the same ids.
        """
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(located(path))
        self.tokenizer.encode_special_tokens = not special
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # chunks are kept here
        alphabet = byte_alphabet()
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        named = {i: t for t, i in self.tokenizer.get_vocab().items()}
        self.size = max(named) + 1
        self.tokens = [
            added[i] if i in added else bytes(alphabet[c] for c in named[i]) if i in named else b"" for i in range(self.size)
        ]
        self.lengths = np.array([len(t) for t in self.tokens])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.specials = [t for t in added.values()] if special else []
        self.table = Table()
        self.ranked = self._ranked(path, added) if ranks and not special else None

    def _ranked(self, path: str, added: dict[int, bytes]) -> tiktoken.Encoding | None:
        with open(located(path), encoding="utf8") as f:
            file = json.load(f)
        merges = [m if isinstance(m, str) else " ".join(m) for m in file["model"]["merges"]]
        vocabulary = file["model"]["vocab"]
        first = len(vocabulary) - len(merges)
        ordered = all(vocabulary.get(m.replace(" ", "", 1)) == first + i for i, m in enumerate(merges))
        splits = file["pre_tokenizer"] or {}
        if not ordered or splits.get("type") != "ByteLevel" or not splits.get("use_regex", True) or file["normalizer"]:
            return None
        ranks = {t: i for i, t in enumerate(self.tokens) if i not in added and t}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [packed(x.ids, self.dtype) for x in found]

    def runs(self, texts: list[str]) -> bytes:
        """Packed ids of texts, one after the other."""
        if self.ranked is None:
            return b"".join(self.whole(texts))
        plain = [t for t in texts if not BEYOND.search(t)]
        if len(plain) < len(texts):
            return b"".join(self.whole([t])[0] if BEYOND.search(t) else self.runs([t]) for t in texts)
        found = map(self.ranked.encode_ordinary, plain)
        return packed(list(chain.from_iterable(found)), self.dtype)

    def encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of each chunk.

        Chunks that begin with white space and end without are encoded many at a
        time as one text, which ends where they end; the others alone.
        """
        wide = WIDE.search(b"".join(chunks).decode()) is not None
        joins = [c for c in chunks if c[0] <= 32 < c[-1] and not (wide and WIDE.search(c.decode()))]
        alone = chunks if len(joins) < len(chunks) else []
        ids = self.runs([b"".join(joins[i : i + RUN]).decode() for i in range(0, len(joins), RUN)])
        ends = np.cumsum(self.lengths[np.frombuffer(ids, self.dtype)])
        cuts = np.searchsorted(ends, np.cumsum([len(c) for c in joins])) + 1
        found = sliced(ids, cuts, self.dtype)
        if alone:
            known = dict(zip(joins, found, strict=True))
            rest = [c for c in chunks if c not in known]
            known.update(zip(rest, self.whole([c.decode() for c in rest]), strict=True))
            return [known[c] for c in chunks]
        return found

    def direct(self, text: bytes) -> bool:
        """Whether a text must be encoded whole."""
        return any(s in text for s in self.specials) or (not text.isascii() and ODD.search(text) is not None)

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of whole texts."""
        out = [b""] * len(texts)
        plain, other = [], []
        for i, text in enumerate(texts):
            if self.direct(text):
                out[i] = self.whole([text.decode()])[0]
            else:
                (plain if single(text) else other).append(i)
        if other:
            parts = [keys(texts[i]) for i in other]
            ids, ends = self._gathered(pa.array(list(chain.from_iterable(parts)), pa.binary()))
            for i, x in zip(other, sliced(ids, ends[np.cumsum([len(p) for p in parts])], self.dtype), strict=True):
                out[i] = x
        if plain:
            for i, x in zip(plain, self._looked_up([texts[i] for i in plain]), strict=True):
                out[i] = x
        return out

    def _gathered(self, chunks: pa.BinaryArray) -> tuple[bytes, np.ndarray]:
        """Packed ids of chunks, named by keys, in turn, and the number of ids before each chunk and after the last.

        Different keys are found by Arrow and looked up in the table; new ones are encoded and kept.
        """
        named = chunks.dictionary_encode()
        own, place = named.dictionary, named.indices.to_numpy()
        found = self.table.places(own)
        at = found.fill_null(-1).to_numpy()
        if found.null_count:
            new = own.filter(found.is_null())
            ids = self.encoded([literal(k) for k in _strings(new)])
            sizes = np.array([len(x) for x in ids], np.int64) // self.dtype.itemsize
            at = np.where(at < 0, self.table.add(new, sizes, b"".join(ids)) + np.cumsum(at < 0) - 1, at)
        place = at[place]
        counts = self.table.sizes[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        # Each chunk's ids in turn, out of those of the different chunks.
        starts = self.table.starts[place] - ends[:-1]
        flat = np.frombuffer(self.table.ids, self.dtype)
        return flat[np.repeat(starts, counts) + np.arange(ends[-1])].tobytes(), ends

    def _looked_up(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of texts with single spaces: the first word by itself, the others split by Arrow."""
        heads, tails = [], []
        for text in texts:
            head, space, tail = text.replace(b"\n", b" \n").partition(b" ")
            heads.append(b" " + head if head else None)
            tails.append(tail if space else None)
        split = pc.split_pattern(pa.array(tails, pa.binary()), b" ")
        first = pa.array([h for h in heads if h], pa.binary())
        ids, ends = self._gathered(pa.concat_arrays([first, split.flatten()]))
        last = len(first) + np.cumsum(split.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        found = iter(sliced(ids, ends[np.concatenate([np.arange(1, len(first) + 1), last])], self.dtype))
        begun = [next(found) if h else b"" for h in heads]
        return [h + rest for h, rest in zip(begun, found, strict=True)]


class PieceModel:
    """A sentencepiece model with byte fallback; it puts a space before every text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=located(path))
        self.size = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(self.size)]
        hidden = [self.model.is_control(i) or self.model.is_unknown(i) for i in range(self.size)]
        self.tokens = [
            b"" if h else bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, (p, h) in enumerate(zip(names, hidden, strict=True))
        ]
        self.lengths = np.array([len(t) for t in self.tokens])
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.sizes = self.lengths.tolist()
        self.space = self.model.piece_to_id("▁")
        own = [p for i, p in enumerate(names) if not hidden[i] and not self.model.is_byte(i)]
        self.cuts = not any(re.search("[^▁]▁", p) or len(p) > 1 and re.search(r"[\t-\r ]", p) for p in own)

    def encoded(self, chunks: list[bytes]) -> list[bytes]:
        """Packed ids of each chunk of a text that follows another one, or begins space + text.

        Chunks that begin with a space and end without are encoded several at a time,
        where the model allows cuts; runs that do not come back in full, and other
        chunks, are encoded alone.
        """
        step = JOINED if self.cuts else 1
        joins = [c for c in chunks if c[0] == 32 != c[-1]]
        runs = [joins[i : i + step] for i in range(0, len(joins), step)]
        ids = self.model.encode([b"".join(r)[1:].decode() for r in runs], num_threads=1)
        whole = [sum(map(len, r)) == sum(map(self.sizes.__getitem__, x)) for r, x in zip(runs, ids, strict=True)]
        joins = list(chain.from_iterable(r for r, w in zip(runs, whole, strict=True) if w))
        flat = np.array(list(chain.from_iterable(x for x, w in zip(ids, whole, strict=True) if w)), self.dtype)
        ends = np.cumsum(self.lengths[flat])
        cuts = np.searchsorted(ends, np.cumsum([len(c) for c in joins])) + 1
        known = dict(zip(joins, sliced(flat.tobytes(), cuts, self.dtype), strict=True))
        rest = [c for c in chunks if c not in known]
        known.update(zip(rest, self._alone(rest), strict=True))
        return [known[c] for c in chunks]

    def _alone(self, chunks: list[bytes]) -> list[bytes]:
        spaced = [c[:1] == b" " for c in chunks]
        found = self.model.encode(
            [c[1:].decode() if s else c.decode() for c, s in zip(chunks, spaced, strict=True)], num_threads=1
        )
        # The space that the model puts before a chunk without one is not the text's.
        return [
            packed([self.space] if c == b" " else ids if s else ids[1:], self.dtype)
            for c, s, ids in zip(chunks, spaced, found, strict=True)
        ]


def spelling(chunks: list[bytes], ids: list[bytes], model: ByteLevel | PieceModel) -> list[bool]:
    """Whether the tokens of each chunk spell it."""

    def spelled(some: list[bytes]) -> bytes:
        return b"".join(map(model.tokens.__getitem__, np.frombuffer(b"".join(some), model.dtype).tolist()))

    flat = np.frombuffer(b"".join(ids), model.dtype)
    last = np.cumsum([len(x) // model.dtype.itemsize for x in ids], dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(model.lengths[flat])])[last]
    if np.array_equal(ends, np.cumsum([len(c) for c in chunks])) and spelled(ids) == b"".join(chunks):
        return [True] * len(chunks)
    return [spelled([x]) == c for c, x in zip(chunks, ids, strict=True)]


@functools.cache
def byte_level(path: str, special: bool, ranks: bool = False) -> ByteLevel:
    return ByteLevel(path, special, ranks)


@functools.cache
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)
