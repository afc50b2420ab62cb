"""Byte-pair encoding as a streaming transducer, and incremental decoding.

A merge list encodes a symbol string so that (1) the encoding of a prefix that ends at a token boundary is a
prefix of the encoding, and (2) a token sequence is an encoding exactly if each adjacent pair is one. So for
every prefix the *last* token of its encoding is fixed: it is the only token that ends there and forms a valid
pair with the last token of the prefix before it. The transducer keeps that last token for each prefix.

Lookahead: no token is longer than ``lookahead`` symbols (computed from the merge list), so a later token can
only attach to one of the last ``lookahead`` prefixes. Only these are kept; the tokens that all of them agree on
are stable and are emitted at once. Memory doesn't grow with the text.

Text is cut before each word that follows a blank; no token reaches over such a place. A block's distinct words are
encoded once, by the transducer, and decoded once, by the state machine; Arrow gathers their bytes into
documents. Words longer than ``LONG`` aren't kept: they are normalised, cut and encoded slice by slice.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.arrow_text import BLANK, LOWER, U64, column, mix, pieces, prefix_sums, span_hash

#: Distinct words, and pieces of them, that a Python worker remembers: between so many and twice as many.
REMEMBERED = 200_000
#: Valid and invalid token pairs that it remembers.
PAIRS = 400_000
#: Bytes of a word beyond which it is encoded slice by slice, and characters in a slice.
LONG, SLICE = 4096, 1024
#: Bytes of text whose distinct words are looked up together.
BLOCK = 2 << 20


def byte_symbols() -> dict[int, str]:
    """The printable stand-in for each byte, by the public byte-level rule: printable Latin-1 characters stand
    for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Transducer:
    """Encodes symbol sequences by a merge list."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], word_end: str = ""):
        self.vocab, self.word_end = vocab, word_end
        self.rank = {pair: i for i, pair in enumerate(map(tuple, merges))}
        singles = [*byte_symbols().values()]
        self.parts = {"": ()} | {s: (s,) for s in [*singles, *(s + word_end for s in singles)] if s in vocab}
        for a, b in self.rank:
            self.parts[a + b] = self.parts[a] + self.parts[b]
        #: Symbols of the longest token: how far back a token may reach, hence the lookahead that settles one.
        self.lookahead = max(map(len, self.parts.values()))
        self.valid: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """Direct application of the merge list: the definition, used to decide which pairs are valid."""
        out = list(symbols)
        while len(out) > 1:
            best = min(range(len(out) - 1), key=lambda i: self.rank.get((out[i], out[i + 1]), 1 << 60))
            if (out[best], out[best + 1]) not in self.rank:
                break
            out[best : best + 2] = [out[best] + out[best + 1]]
        return out

    def pair(self, a: str, b: str) -> bool:
        found = self.valid.get((a, b))
        if found is None:
            if len(self.valid) >= PAIRS:
                self.valid.clear()
            found = self.valid[a, b] = self.merged(self.parts[a] + self.parts[b]) == ([a, b] if a else [b])
        return found

    def word(self, text: str) -> list[str]:
        """The tokens of one piece of single-character symbols, its last symbol marked as a word end.

        Within the lookahead nothing has to be emitted early, so the states are two plain lists.
        """
        n, look, parts, known = len(text), self.lookahead, self.parts, self.valid.get
        if n > look:
            return list(self.tokens([*text[:-1], text[-1] + self.word_end]))
        last, start = [""] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            tail = self.word_end if i == n else ""
            for j in range(i):
                if (j == 0 or last[j]) and (token := text[j:i] + tail) in parts:
                    ok = known((last[j], token))
                    if ok or ok is None and self.pair(last[j], token):
                        last[i], start[i] = token, j
                        break
        out, i = [], n
        while i:
            out.append(last[i])
            i = start[i]
        return out[::-1]

    def tokens(self, symbols: Iterable[str]) -> Iterator[str]:
        """Yields tokens as soon as they are stable. ``symbols`` may be endless."""
        stream = Stream(self)
        for symbol in symbols:
            yield from stream.push(symbol)
        yield from stream.rest()


class Stream:
    """One symbol string on its way through a transducer."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        # state of a prefix: (end, its last token, state before that token); only the newest ``lookahead`` are held
        self.window: list[tuple] = [(0, "", None)]
        self.recent: list[str] = []
        self.n = 0

    def push(self, symbol: str) -> list[str]:
        """Takes one symbol; returns the tokens that have become stable."""
        look, parts, pair, window = self.machine.lookahead, self.machine.parts, self.machine.pair, self.window
        self.n += 1
        recent = self.recent
        recent.append(symbol)
        if len(recent) > look:
            del recent[0]
        text, state = "".join(recent), None
        at = 0  # where the candidate token starts in ``text``
        for k, first in enumerate(recent):
            size = len(recent) - k
            if size <= len(window) and (before := window[-size]) is not None and (token := text[at:]) in parts and pair(before[1], token):
                state = (self.n, token, before)
                break
            at += len(first)
        window.append(state)
        if len(window) > 2 * look:
            self.window, out = self._settle(window[-look:])
            return out
        return []

    def rest(self) -> list[str]:
        """The tokens that are left when the string has ended."""
        return self._path(self.window[-1])

    @staticmethod
    def _path(state: tuple) -> list[str]:
        out = []
        while state is not None and state[2] is not None:
            out.append(state[1])
            state = state[2]
        return out[::-1]

    @staticmethod
    def _settle(window: list) -> tuple[list, list[str]]:
        """The window with what its prefixes share cut off, and those shared tokens."""
        paths = []
        for s in window:
            chain = []
            while s is not None:
                chain.append(s)
                s = s[2]
            paths.append(chain[::-1])
        paths = [p for p in paths if p]
        shared = 0
        while all(len(p) > shared + 1 for p in paths) and len({id(p[shared + 1]) for p in paths}) == 1:
            shared += 1
        if not shared:
            return window, []
        out = [s[1] for s in paths[0][1 : shared + 1]]
        cut = paths[0][shared]
        fresh: dict[int, tuple] = {id(cut): (cut[0], cut[1], None)}

        def renew(s: tuple) -> tuple:
            chain = []
            while id(s) not in fresh:
                chain.append(s)
                s = s[2]
            for s in reversed(chain):
                fresh[id(s)] = (s[0], s[1], fresh[id(s[2])])
            return fresh[id(chain[0])] if chain else fresh[id(s)]

        return [None if s is None else renew(s) for s in window], out


class Pieces:
    """The transducer over many pieces at a time: one step for each prefix length, all pieces in it together.

    ``last`` holds each prefix's last token. A token that ends at a prefix is the right one if it forms a valid pair with
    the last token of the prefix before it. No piece is longer than the lookahead, so nothing has to leave early.
    """

    SLOTS = 21

    def __init__(self, machine: Transducer):
        back = {c: b for b, c in byte_symbols().items()}
        self.machine, self.names = machine, list(machine.parts)
        ends = [bool(machine.word_end) and t.endswith(machine.word_end) for t in self.names]
        raw = [bytes([back[c] for c in (t[: -len(machine.word_end)] if e else t)]) for t, e in zip(self.names, ends, strict=True)]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        key = span_hash(prefix_sums(np.frombuffer(b"".join(raw), np.uint8)), bounds[:-1], bounds[1:])
        key = np.where(ends, mix(key), key)
        self.token = np.argsort(key)
        self.key = key[self.token]
        self.near = np.zeros(1 << 20, bool)
        self.near[(key >> U64(44)).astype(np.int64)] = True
        # a direct-mapped table of pairs in front of the machine's own memory
        self.pairs, self.valid = np.full(1 << self.SLOTS, -1, np.int64), np.zeros(1 << self.SLOTS, bool)
        self.ids = np.array([machine.vocab.get(t, 0) for t in self.names], np.int64)

    def _tokens(self, data: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first byte, end byte, token) of all tokens inside the pieces; ``end`` is the end of each byte's piece."""
        sums, at, found = prefix_sums(data), np.arange(len(data)), []
        for size in range(1, self.machine.lookahead + 1):
            at = at[at + size <= end[at]]
            if not len(at):
                break
            h = span_hash(sums, at, at + size)
            whole = at + size == end[at]
            h[whole] = mix(h[whole])
            here = np.flatnonzero(self.near[(h >> U64(44)).astype(np.int64)])
            k = np.minimum(np.searchsorted(self.key, h[here]), len(self.key) - 1)
            hit = self.key[k] == h[here]
            found.append((at[here[hit]], at[here[hit]] + size, self.token[k[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        slot = (mix(key.view(U64)) >> U64(64 - self.SLOTS)).astype(np.int64)
        ok = self.valid[slot]
        new = np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            ask, of = np.unique(key[new], return_inverse=True)
            told = np.array([self.machine.pair(self.names[k >> 32], self.names[k & 0xFFFFFFFF]) for k in ask.tolist()], bool)[of]
            ok[new] = told
            self.pairs[slot[new]], self.valid[slot[new]] = key[new], told
        return ok

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """Each piece's ids. No piece is empty or longer than the lookahead."""
        if not raw:
            return []
        size = np.array([len(r) for r in raw])
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(raw), np.uint8)
        piece = np.repeat(np.arange(len(raw)), size)
        begin, end, token = self._tokens(data, (start + size)[piece])
        # prefix states: one more than bytes in each piece
        own = piece[begin]
        source, state, reach = begin + own, end + own, end - start[own]
        order = np.argsort(reach, kind="stable")
        source, state, token = source[order], state[order], token[order]
        steps = np.searchsorted(reach[order], np.arange(1, int(size.max()) + 2))
        last, origin = np.full(len(data) + len(raw), -1), np.full(len(data) + len(raw), -1)
        last[start + np.arange(len(raw))] = 0  # rank 0 is the empty token
        for a, b in zip(steps[:-1], steps[1:], strict=True):
            before = last[source[a:b]]
            ok = before >= 0
            ok[ok] = self._pairs(before[ok], token[a:b][ok])
            last[state[a:b][ok]], origin[state[a:b][ok]] = token[a:b][ok], source[a:b][ok]
        now, of, back = start + size + np.arange(len(raw)), np.arange(len(raw)), []
        while len(now):
            back.append((of, last[now]))
            now = origin[now]
            more = origin[now] >= 0
            now, of = now[more], of[more]
        of, token = np.concatenate([x for x, _ in back[::-1]]), np.concatenate([x for _, x in back[::-1]])
        order = np.argsort(of, kind="stable")
        ids, cuts = self.ids[token[order]].astype("<u4").tobytes(), (4 * np.searchsorted(of[order], np.arange(len(raw) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Memo:
    """A bounded memory: what hasn't been asked for during a whole filling is forgotten."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.most:
            self.old, self.new = self.new, {}
        self.new[key] = value


class WordTokenizer:
    """A vocabulary file with end-of-word symbols: NFC, white space runs as one space, lower case, then pieces.

    Beyond ASCII the Unicode version matters, so normal form, lower case and character classes are asked of the
    file's own normaliser and splitter; the merges are the transducer's.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, lib = spec["model"], Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.machine = Transducer(self.vocab, model["merges"], self.end)
        self.normal, self.split = lib.normalizer.normalize_str, lib.pre_tokenizer.pre_tokenize_str
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        # the classes of lower-cased ASCII; its white space is tab to carriage return and the space
        self.ascii = re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").replace(r"\s", r"\t-\r ").replace("[[", "[").replace("]]", "]"))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.bytes = byte_symbols()
        self.token_of = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.together = Pieces(self.machine)
        self.known = Memo(REMEMBERED)
        names = [self.token_of.get(i, "") for i in range(max(self.token_of) + 1)]
        self.shown = pa.array([(t + " ").encode() for t in names], pa.large_binary())
        self.bytes_of = pa.array([ByteDecoder.raw(t, self.end) for t in names], pa.large_binary())

    def piece(self, symbols: str) -> list[int]:
        """Ids of one piece, given as byte symbols."""
        return [self.vocab[t] for t in self.machine.word(symbols)]

    def cut(self, text: str) -> list[bytes]:
        """The pieces of a text without special tokens, as bytes."""
        if text.isascii():
            return [p.encode() for p in self.ascii.findall(text.lower())]
        back = ByteDecoder.back
        return [p.encode() if p.isascii() else bytes([back[c] for c in p]) for p, _ in self.split(self.normal(text))]

    def ids(self, text: str) -> Iterator[int]:
        """Token ids of any text, as they become stable."""
        for k, part in enumerate(self.specials.split(text) if "<|" in text else [text]):
            if k % 2:
                yield self.special[part]
            elif len(part) > LONG:
                yield from self._slices(part)
            else:
                for p in self.cut(part):
                    yield from self.piece("".join([self.bytes[b] for b in p]))

    def _slices(self, text: str) -> Iterator[int]:
        """``ids`` of a long text that is normalised and split a slice at a time. A piece that reaches over a slice goes
        to the transducer as it comes."""
        held, stream, kind, waiting = "", None, "", ""

        def feed(symbols: str) -> Iterator[int]:
            # the last symbol waits, since only the end of the piece is marked
            nonlocal waiting
            for symbol in symbols:
                if waiting:
                    for t in stream.push(waiting):
                        yield self.vocab[t]
                waiting = symbol

        def close() -> Iterator[int]:
            nonlocal stream, waiting
            for t in [*stream.push(waiting + self.end), *stream.rest()]:
                yield self.vocab[t]
            stream, waiting = None, ""

        for part in self._cut(text):
            text_ = held + self.normal(part)
            held = ""
            if stream is not None:  # goes the open piece on? ask with a character of its class in front
                found = self.split(kind + text_)
                size = found[0][1][1] - 1
                yield from feed(found[0][0][1:])
                if size == len(text_):
                    continue
                yield from close()
                text_ = text_[size:]
            found = self.split(text_)
            if not found:
                continue
            last = len(found) - 1
            if len(found) > 1 and found[-2][0] == "'" and found[-2][1][1] == found[-1][1][0]:
                last -= 1  # may become a contraction
            for p, _ in found[:last]:
                yield from self.piece(p)
            at, end = found[last][1][0], found[-1][1][1]
            if end < len(text_):  # white space follows: the pieces are whole
                for p, _ in found[last:]:
                    yield from self.piece(p)
            elif last < len(found) - 1 or end - at < 8:
                held = text_[at:]
            else:
                kind = "a" if len(self.split("a" + text_[at : at + 1])) == 1 else "!"
                stream = Stream(self.machine)
                yield from feed(found[last][0])
        if stream is not None:
            yield from close()
        for p, _ in self.split(held):
            yield from self.piece(p)

    def _cut(self, text: str) -> Iterator[str]:
        """Slices between which the normal form doesn't reach: before ASCII, or before a character that isn't a mark and
        doesn't combine with the three before it."""
        a = 0
        while a < len(text):
            b = a + SLICE
            while b < len(text) and not text[b].isascii():
                before, c = text[b - 3 : b], text[b]
                if unicodedata.category(c)[0] not in "MC" and self.normal(before + c) == self.normal(before) + self.normal(c):
                    break
                b += 1
            yield text[a:b]
            a = b

    def words(self, raw: list[bytes]) -> list[bytes]:
        """Ids, as little-endian 32-bit integers, of words or of plain pieces: lower-case ASCII of one class."""
        get = self.known.new.get
        found: list = [get(w) for w in raw]
        plans: list[tuple[int, list[bytes]]] = []
        have: dict[bytes, bytes] = {}
        for k in [k for k, x in enumerate(found) if x is None]:
            w = raw[k]
            found[k] = self.known.get(w)
            if found[k] is None:
                if len(w) > LONG or b"<|" in w:
                    found[k] = array("I", self.ids(w.decode())).tobytes()
                else:
                    plans.append((k, [w] if w.isascii() and w.isalpha() and w.islower() else self.cut(w.decode())))
        ask = set()
        for _, plan in plans:
            ask.update(plan)
        for p in ask:
            if (x := self.known.get(p)) is not None:
                have[p] = x
        ask = [p for p in ask if p not in have]
        short = [p for p in ask if len(p) <= self.machine.lookahead]
        have.update(zip(short, self.together.encode(short), strict=True))
        put = self.known.put
        for p in ask:
            if p not in have:
                have[p] = array("I", self.piece("".join([self.bytes[b] for b in p]))).tobytes()
            if len(p) < 64:
                put(p, have[p])
        for k, plan in plans:
            found[k] = have[plan[0]] if len(plan) == 1 else b"".join([have[p] for p in plan])
            if len(raw[k]) < 64 and len(plan) > 1:
                put(raw[k], found[k])
        return found

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian 32-bit integers."""
        return b"".join(self.words(re.findall(rb"[^\t-\r ]+", text.encode())))

    def decode(self, ids: bytes) -> bytes:
        """What the file's decoder gives, in UTF-8: it names none, so token strings joined by spaces."""
        return " ".join([self.token_of[i] for i in np.frombuffer(ids, "<u4").tolist()]).encode()

    def read(self, ids: bytes) -> str:
        """Readable text: bytes behind the symbols, a space for each word end."""
        machine = ByteDecoder(self.end)
        return "".join([*(machine.push(self.token_of[i]) for i in np.frombuffer(ids, "<u4").tolist()), machine.close()])


class ByteDecoder:
    """Turns token bytes into text as they come: holds back only the bytes of an unfinished character (3 at most)."""

    back = {c: b for b, c in byte_symbols().items()}

    def __init__(self, word_end: str = ""):
        self.end, self.held = word_end, b""

    @classmethod
    def raw(cls, token: str, word_end: str) -> bytes:
        """The bytes behind a token's symbols; a word end is a space, a special token stands for itself."""
        closed = bool(word_end) and token.endswith(word_end)
        body = token[: -len(word_end)] if closed else token
        return (bytes([cls.back[c] for c in body]) if all(c in cls.back for c in body) else body.encode()) + b" " * closed

    def push(self, token: str) -> str:
        return self.feed(self.raw(token, self.end))

    def feed(self, more: bytes) -> str:
        raw = self.held + more
        keep = next((k for k in (3, 2, 1) if len(raw) >= k and self._unfinished(raw[-k:])), 0)
        self.held = raw[len(raw) - keep :]
        return raw[: len(raw) - keep].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(tail: bytes) -> bool:
        need = 4 if tail[0] >= 0xF0 else 3 if tail[0] >= 0xE0 else 2 if tail[0] >= 0xC0 else 0
        return need > len(tail) and all(0x80 <= b < 0xC0 for b in tail[1:])

    def close(self) -> str:
        out, self.held = self.held.decode("utf-8", "replace"), b""
        return out


#: One tokenizer for each vocabulary in a Python worker; it serves all tasks that the worker runs.
_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
        gc.freeze()  # large tables that stay need no scans
    return _TOKENIZERS[path]


#: Classes of lower-case ASCII in the splitting pattern: letters, digits (which stand alone), others.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[97:123], _CLASS[48:58] = 0, 1


def distinct_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(parts of all texts, bounds of each text's parts). An ASCII word without ``<`` or an apostrophe is lower-cased and
    cut into its pieces, which is what becomes of it anyway; any other word is one part."""
    inside = ~BLANK[data]
    begin = np.zeros(len(data) + 1, bool)
    begin[offsets] = True
    begin[1:-1] |= ~inside[:-1]
    begin = begin[:-1] & inside
    data_, first = data[inside], begin[inside]
    at = np.append(np.flatnonzero(first), len(data_))
    odd = np.add.reduceat((data_ >= 128) | (data_ == 60) | (data_ == 39), at[:-1], dtype=np.int32) > 0 if len(at) > 1 else np.zeros(0, bool)
    odd = np.repeat(odd, np.diff(at))
    low = LOWER[data_]
    kind = _CLASS[low]
    change = np.zeros(len(data_), bool)
    change[1:] = ((kind[1:] != kind[:-1]) | (kind[1:] == 1)) & ~odd[1:]
    first |= change
    mark = np.zeros(len(data), np.int32)
    mark[inside] = first
    at = np.append(np.flatnonzero(first), len(data_)).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.where(odd, data_, low))])
    return parts.dictionary_encode(), np.concatenate([[0], np.cumsum(mark)])[offsets]


def gathered(values: pa.Array, indices: pa.Array, bounds: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """(bytes, bounds): for each text the binary values of its parts, one after the other."""
    if not len(indices):
        return memoryview(b""), np.zeros(len(bounds), np.int64)
    _, offsets, data = values.take(indices).buffers()
    return memoryview(data) if data is not None else memoryview(b""), np.frombuffer(offsets, np.int64)[bounds]


def readable(raw: memoryview) -> bytes:
    """A text's token bytes through the decoder, a stretch at a time, as UTF-8."""
    decoder, out = ByteDecoder(), []
    for k in range(0, len(raw), 1 << 16):
        out.append(decoder.feed(bytes(raw[k : k + (1 << 16)])))
    return "".join([*out, decoder.close()]).encode()


def encode_documents(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, text_sha256[, ids binary]) for every row.

    decoded_sha256 is of the library's decoding, text_sha256 of the readable one (bytes behind the symbols, a space
    for each word end). A null or blank text has no tokens and the digests of no bytes. Repeated rows stay
    repeated; other columns of ``docs`` are not read. ``path`` must be readable on every executor.
    """
    digests = ("ids_sha256", "decoded_sha256", "text_sha256")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            keys = column(batch, "doc_id")
            for a, b, offsets, data in pieces(column(batch, "text"), BLOCK):
                parts, bounds = distinct_parts(data, offsets)
                words = pa.array(tok.words(parts.dictionary.to_pylist()), pa.large_binary())
                held, at = gathered(words, parts.indices, bounds)
                n = np.diff(at) // 4
                cuts = np.concatenate([[0], np.cumsum(n)])
                tokens = pa.array(np.frombuffer(held, "<u4")[: cuts[-1]])
                shown, ends = gathered(tok.shown, tokens, cuts)
                read, stops = gathered(tok.bytes_of, tokens, cuts)
                spans = [(held, i, j) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                out = [pa.array([hashlib.sha256(x[i:j]).hexdigest() for x, i, j in spans], pa.string())]
                # no space behind the last token
                out.append(pa.array([hashlib.sha256(shown[i : max(i, j - 1)]).hexdigest() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
                out.append(pa.array([hashlib.sha256(readable(read[i:j])).hexdigest() for i, j in zip(stops[:-1].tolist(), stops[1:].tolist(), strict=True)], pa.string()))
                raw = [pa.array([bytes(x[i:j]) for x, i, j in spans], pa.binary())] if ids else []
                yield pa.RecordBatch.from_arrays([keys.slice(a, b - a), pa.array(n), *out, *raw], names=["doc_id", "n_tokens", *digests, *(["ids"] if ids else [])])

    schema = "doc_id long, n_tokens long, " + ", ".join(f"{c} string" for c in digests) + (", ids binary" if ids else "")
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
