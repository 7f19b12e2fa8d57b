"""BPE encoding by a bounded-lookahead streaming transducer, and an incremental decoder.

``Merges`` reads a merge list with end-of-word symbols. Two facts carry the transducer: the encoding of a
prefix that ends at a token boundary is a prefix of the tokens, and a token sequence is the encoding of its
text exactly if each adjacent pair is the encoding of its own text. So the last token of every prefix is
the one token that ends there and goes with the last token of what stands before it. No token is longer
than ``lookahead`` symbols (computed from the merge list), so at most that many prefixes are open; a token
is emitted as soon as all open prefixes share it, and memory stays constant for words of any length.
Every word goes through this transducer; a task keeps what it emitted for the words of its cache.

Ids leave the encoder in runs of about RUN and enter the incremental decoder as such: its state between runs is whether
anything came before (token strings, joined by one space as the file names no decoder) or the open bytes of a
character (text). No list of a whole text's ids is held for the digests.

Texts are split as the tokenizer file says: special tokens, NFC, white space, lower case, pre-tokens, byte
symbols. Defined cases: null and empty texts have no tokens; an empty table gives an empty result; for the digests, very
long texts take the memory of the text and of its lower-cased form, and very long words that of the word besides; repeated rows give repeated results; a null doc_id is carried through; extra
columns are ignored; a doc_id that is no integer is an error of the cast; a file whose special tokens strip or need single
words is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain
from os.path import commonprefix
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm import _words as W

RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
KEPT = 48
RUN = 4096
LISTED = 1 << 16
CACHE = 400_000
#: Fixed values of the format: contractions, letters, single digits, other marks; white space between them.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r a-z0-9]+")
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next character from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, n = {}, 256
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(n)
            n += 1
    return [out[b] for b in range(256)]


BYTE = {s: b for b, s in enumerate(byte_symbols())}


class Merges:
    """A merge list and its vocabulary; END marks the last symbol of a word."""

    END = "</w>"

    def __init__(self, raw: str):
        model = json.loads(raw)
        if any(x.get(k) for x in model["added_tokens"] for k in ("lstrip", "rstrip", "single_word")):
            raise ValueError("special tokens that strip or need single words are not supported")
        self.special = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab = model["model"]["vocab"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): i for i, m in enumerate(model["model"]["merges"])}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        made = {a + b for a, b in self.rank}
        symbols = byte_symbols()
        single = set(symbols) | {s + self.END for s in symbols}
        usable = {t: i for t, i in vocab.items() if t in made or t in single}
        # A token that its own text does not encode to never occurs.
        usable = {t: i for t, i in usable.items() if t in single or self._naive(t) == [t]}
        self.inner = {t: i for t, i in usable.items() if not t.endswith(self.END)}
        self.last = {t[: -len(self.END)]: i for t, i in usable.items() if t.endswith(self.END)}
        self.size = {i: len(t) for d in (self.inner, self.last) for t, i in d.items()}
        self.lookahead = max(self.size.values())
        self.pairs: dict[tuple[int, int], bool] = {}

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self.END) and len(token) > len(self.END):
            body = token[: -len(self.END)]
            return [*body[:-1], body[-1] + self.END]
        return list(token)

    def _naive(self, token: str) -> list[str]:
        """Merges applied by rank, for texts of at most two tokens."""
        parts = self._symbols(token)
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), 1 << 40))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def goes(self, a: int, b: int) -> bool:
        """Is the text of tokens a and b encoded as these two?"""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self._naive(self.token[a] + self.token[b]) == [self.token[a], self.token[b]]
        return known

    def stream(self, symbols: Iterable[str]) -> Iterator[int]:
        """Encode one word of any length in constant memory: tokens leave as soon as all open prefixes share them."""
        most, inner, pairs = self.lookahead, self.inner, self.pairs
        text, at, settled, before = "", 0, 0, None  # the last symbols; places from the word's start
        ends: dict[int, tuple[int, int]] = {}  # place -> (last token of that prefix, place before it)
        came = iter(symbols)
        symbol = next(came, None)
        while symbol is not None:
            following = next(came, None)
            text += symbol
            at += 1
            n = len(text)
            known = self.last if following is None else inner
            for size in range(1, min(most, at - settled) + 1):
                token = known.get(text[n - size :])
                if token is None:
                    continue
                p = at - size
                if not p:
                    ends[at] = (token, 0)
                    break
                if p == settled:
                    left = before
                elif p in ends:
                    left = ends[p][0]
                else:
                    continue
                goes = pairs.get((left, token))
                if goes or goes is None and self.goes(left, token):
                    ends[at] = (token, p)
                    break
            if following is None:
                stable = [self._chain(ends, at, settled)]
            elif at - settled >= 2 * most:
                stable = [self._chain(ends, p, settled) for p in ends if p > at - most]
            else:
                stable = ()
            if stable:
                shared = 0
                while all(len(c) > shared and c[shared] == stable[0][shared] for c in stable):
                    shared += 1
                for p, token in stable[0][:shared]:
                    yield token
                    settled, before = p, token
                ends = {p: x for p, x in ends.items() if p > settled}
                text = text[-2 * most :] if len(text) > 4 * most else text
            symbol = following

    @staticmethod
    def _chain(ends: dict, p: int, settled: int) -> list[tuple[int, int]]:
        chain = []
        while p > settled:
            token, left = ends[p]
            chain.append((p, token))
            p = left
        return chain[::-1]


class Decoder:
    """Incremental decoding: ids to token strings, to bytes, and to text by a UTF-8 state machine."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.byte = BYTE
        self.need, self.code = 0, 0
        self.low, self.high = 0x80, 0xBF
        self.first = True

    def strings(self, ids: Iterable[int]) -> str:
        """What a run of ids adds to the token strings, joined by one space: the file names no decoder."""
        added = " ".join(map(self.merges.token.__getitem__, ids))
        first, self.first = self.first, self.first and not added
        return added if first or not added else " " + added

    def bytes(self, ids: Iterable[int]) -> Iterator[int]:
        special = set(self.merges.special.values())
        for i in ids:
            token = self.merges.token[i]
            if i in special:
                yield from token.encode()
                continue
            ends = token.endswith(Merges.END)
            for s in token[: -len(Merges.END)] if ends else token:
                yield self.byte[s]
            if ends:
                yield 32

    def text(self, ids: Iterable[int], final: bool = True) -> Iterator[str]:
        """Characters as soon as they are complete; broken sequences become U+FFFD, an open one only if ``final``."""
        for b in self.bytes(ids):
            if self.need:
                if self.low <= b <= self.high:
                    self.code = self.code << 6 | b & 63
                    self.low, self.high = 0x80, 0xBF
                    self.need -= 1
                    if not self.need:
                        yield chr(self.code)
                    continue
                self.need, self.low, self.high = 0, 0x80, 0xBF
                yield "�"
            if b < 0x80:
                yield chr(b)
            elif 0xC2 <= b <= 0xDF:
                self.need, self.code = 1, b & 31
            elif 0xE0 <= b <= 0xEF:
                self.need, self.code = 2, b & 15
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.code = 3, b & 7
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                yield "�"
        if self.need and final:
            self.need, self.low, self.high = 0, 0x80, 0xBF
            yield "�"


class Codec:
    """Whole texts: splitting, words and their cached encodings."""

    def __init__(self, raw: str):
        self.merges = Merges(raw)
        special = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
        self.mark = commonprefix(special)
        self.plain = str.maketrans({i: s for i, s in enumerate(byte_symbols()[:128])})
        self.symbols = byte_symbols()
        self.known: dict[str, tuple[int, ...]] = {}
        self.number = {i: str(i) for i in self.merges.token}

    def words(self, text: str) -> Iterable[str]:
        """Pre-tokens of a text without special tokens; one by one where the text is long."""
        if text.isascii():
            split, text = SPLIT_ASCII, text.lower()
        else:
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            split, text = SPLIT, text.replace("Σ", "σ").lower()
        return split.findall(text) if len(text) <= LISTED else (m.group() for m in split.finditer(text))

    def word(self, word: str) -> tuple[int, ...]:
        """Ids of a pre-token of at most KEPT characters, kept for the next time."""
        ids = tuple(self.stream(word))
        if len(self.known) >= CACHE:
            self.known.clear()
        self.known[word] = ids
        return ids

    def stream(self, word: str) -> Iterator[int]:
        """Ids of a pre-token as the transducer emits them; its bytes are mapped in pieces."""
        if word.isascii():
            return self.merges.stream(word.translate(self.plain) if len(word) <= KEPT else (c.translate(self.plain) for c in word))
        return self.merges.stream(self.symbols[b] for i in range(0, len(word), RUN) for b in word[i : i + RUN].encode())

    def parts(self, text: str) -> Iterator[str | int]:
        """Runs of ordinary text, and ids of special tokens."""
        if self.special is None or self.mark not in text:
            yield text
            return
        for i, part in enumerate(self.special.split(text)):
            yield self.merges.special[part] if i % 2 else part

    def runs(self, text: str | None) -> Iterator[list[int]]:
        """Ids of a text in runs of about RUN."""
        known, out = self.known, []
        for part in self.parts(text or ""):
            if isinstance(part, int):
                out.append(part)
                continue
            for w in self.words(part):
                if len(w) > KEPT:
                    for i in self.stream(w):
                        out.append(i)
                        if len(out) >= RUN:
                            yield out
                            out = []
                    continue
                out += known.get(w) or self.word(w)
                if len(out) >= RUN:
                    yield out
                    out = []
        if out:
            yield out

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.runs(text)))

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, and SHA-256 of ids and of what the incremental decoder makes of them."""
        n, ids, back, decoder = 0, hashlib.sha256(), hashlib.sha256(), Decoder(self.merges)
        number = self.number.__getitem__
        for run in self.runs(text):
            ids.update(((" " if n else "") + " ".join(map(number, run))).encode())
            back.update(decoder.strings(run).encode())
            n += len(run)
        return n, ids.hexdigest(), back.hexdigest()


_CODECS: dict[str, Codec] = {}


def codec(raw: str) -> Codec:
    """One codec a worker: its caches outlive a task."""
    name = hashlib.sha256(raw.encode()).hexdigest()
    if name not in _CODECS:
        _CODECS.clear()
        _CODECS[name] = Codec(raw)
    return _CODECS[name]


def encode_corpus(docs: DataFrame, path: str, digests: bool = True) -> DataFrame:
    """Ids (``digests=False``: doc_id, ids) or their digests, for every whole text."""
    raw = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches):
        own = codec(raw.value)
        for batch in batches:
            for part in W.slices(batch):
                texts = part.column(1).to_pylist()
                if digests:
                    n, ids, back = zip(*map(own.digest, texts), strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(map(own.encode, texts)), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT if digests else "doc_id long, ids array<int>")


def decode_corpus(encoded: DataFrame, path: str) -> DataFrame:
    """Text of ids (doc_id, ids), byte by byte; words are separated by one space."""
    raw = encoded.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches):
        own = codec(raw.value)
        for batch in batches:
            texts = ["".join(Decoder(own.merges).text(x or ())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    from tracelake.llm._io import table

    return encode_corpus(table(spark, sf_dir, "documents"), default_path())
