"""BPE encoding and decoding by a streaming transducer with bounded lookahead.

Encoding reads a word's bytes from left to right and holds the encoding of what it has read: the one path of tokens of which
the merge procedure leaves each two neighbours as they are. What follows can change the path's end only. A rule changes
what stands left of it only through a rule of a later rank whose right operand begins with its left operand, so that the
longest such chain of left operands, computed once from the merge list, is a sufficient lookahead: tokens that end so far
before the place reached are settled. They are emitted and forgotten, and a word of any length takes a bounded window.

Decoding is a state machine from bytes to text: tokens give bytes, whole characters leave, an unfinished one waits in
the state; what can't become a character leaves as U+FFFD.

Texts are cut as the public library does it: special tokens first, then normal form C, lower case, and runs of letters,
single digits and runs of other marks; white space is dropped.

Null and empty texts have no tokens and decode to an empty text. Very long texts and words are encoded whole; equal rows
have equal results, with or without doc_id. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import in_batches

MODEL = "/opt/tokenizers/word_bpe_49k.json"
#: Lengths of a token of two symbols, for places where no longer token ends.
PAIR = (2,)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: visible Latin-1 characters stand for themselves, the others follow from 256 on."""
    visible = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """A byte-level merge list whose words end in a mark of their own.

    A symbol is one character: a byte as its number, the last byte of a word as 256 more.
    """

    def __init__(self, vocabulary: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        letters = byte_letters()

        def symbols(token: str) -> str:
            plain = token[: -len(suffix)] if suffix and token.endswith(suffix) and token != suffix else token
            out = "".join([chr(letters[c]) for c in plain])
            return out if plain == token else out[:-1] + chr(ord(out[-1]) + 256)

        self.marked = bool(suffix)
        self.ids = {symbols(t): k for t, k in vocabulary.items()}
        self.rules = [(symbols(a), symbols(b)) for a, b in merges]
        self.rank = {pair: r for r, pair in enumerate(self.rules)}
        begins: dict[str, set[int]] = {}
        for t in self.ids:
            if len(t) > 2:
                begins.setdefault(t[:3], set()).add(len(t))
        #: Lengths of the tokens that begin with three given symbols, longest first, and that of a pair.
        self.lengths = {e: (*sorted(n, reverse=True), 2) for e, n in begins.items()}
        #: The longest other token that a token begins with; none behind a single symbol.
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), "") for t in self.ids}
        self.lookahead = sufficient_lookahead(self.rules)
        self.window = 2 * max(self.lookahead, max(map(len, self.ids)))
        self.fits: dict[str, bool] = {}

    def merged(self, symbols: str) -> list[str]:
        """The merge procedure itself: the rule of the lowest rank first, at its leftmost place."""
        parts, rank = list(symbols), self.rank
        while len(parts) > 1:
            r, k = min((rank.get((a, b), len(rank)), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if r == len(rank):
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, pair: str, left: str, right: str) -> bool:
        """Whether the merge procedure leaves the two as they are (right alone at a word's start); kept in `fits` under `pair`."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        known = self.fits[pair] = self.merged(left + right) == ([left, right] if left else [right])
        return known


def sufficient_lookahead(rules: list[tuple[str, str]]) -> int:
    """How many symbols behind a token's end settle it, whatever follows them.

    What isn't known yet lies right of a frontier. A rule across it takes its left operand into the unknown, which can
    matter further left only for rules of later rank whose right operand begins with that operand. So the frontier moves
    by the left operands along a chain of such rules; the longest chain is found from the last rule to the first.
    """
    left_of = {a + b: a for a, b in reversed(rules)}
    reach: dict[str, int] = {}  # by symbol: the longest chain of later rules that a change in front of it can start
    longest = 0
    for a, b in reversed(rules):
        length = len(a) + reach.get(a, 0)
        longest = max(longest, length)
        begins = b
        while begins:
            if reach.get(begins, 0) < length:
                reach[begins] = length
            begins = left_of.get(begins, "")
    return longest + 1


class Transducer:
    """Encodes one word, run of symbols by run of symbols; tokens come out as soon as they are settled."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.text, self.before = "", ""  # what isn't emitted yet, and the token in front of it

    def feed(self, symbols: str) -> list[str]:
        """Read more of the word; returns the tokens that are settled now."""
        merges, out = self.merges, []
        for start in range(0, len(symbols), merges.window):
            self.text += symbols[start : start + merges.window]
            if len(self.text) > merges.window:
                out += self._settled(len(self.text) - merges.lookahead)
        return out

    def finish(self) -> list[str]:
        """The word's remaining tokens; the transducer is ready for the next word."""
        out = self._path()
        self.text, self.before = "", ""
        return out

    def _path(self) -> list[str]:
        """The encoding of the text held: of each place's tokens the longest first that fits behind the last.

        A path that can't go on is taken back token by token; a place from which nothing goes on is looked at once.
        """
        text, merges, path = self.text, self.merges, []
        ids, lengths, shorter, fits = merges.ids, merges.lengths, merges.shorter, merges.fits
        at, size = 0, len(text)
        dead: set[int] = set()
        token = None
        while at < size:
            if token is None:
                token = text[at]
                for n in lengths.get(text[at : at + 3], PAIR):
                    if (longer := text[at : at + n]) in ids:
                        token = longer
                        break
            left = path[-1] if path else self.before
            while token:
                if at + len(token) not in dead:
                    pair = left + "\uffff" + token
                    known = fits.get(pair)
                    if known or (known is None and merges.fit(pair, left, token)):
                        break
                token = shorter[token]
            if token:
                path.append(token)
                at += len(token)
                token = None
            else:
                dead.add(at)
                last = path.pop()
                at -= len(last)
                token = shorter[last]
        return path

    def _settled(self, until: int) -> list[str]:
        """Drop and return the tokens that end at `until` or before."""
        at, out = 0, []
        for token in self._path():
            if at + len(token) > until:
                break
            out.append(token)
            at += len(token)
        if out:
            self.text, self.before = self.text[at:], out[-1]
        return out


class Decoder:
    """Ids to text, token by token; `joint` stands between two tokens."""

    def __init__(self, raw: dict[int, bytes], joint: bytes = b""):
        self.raw, self.joint = raw, joint
        self.reset()

    def reset(self) -> None:
        self.state, self.begun = codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int]) -> str:
        """The characters that are whole now; ids that the vocabulary lacks add nothing."""
        parts = [self.raw[k] for k in ids if k in self.raw]
        if not parts:
            return ""
        before = self.joint if self.begun else b""
        self.begun = True
        return self.state.decode(before + self.joint.join(parts))

    def finish(self) -> str:
        """What is left, as U+FFFD; the machine is ready for the next text."""
        out = self.state.decode(b"", final=True)
        self.reset()
        return out

    def text(self, ids: Iterable[int]) -> str:
        return self.feed(ids) + self.finish()


@cache
def characters(kind: str) -> str:
    """The characters of a property as the library has it, as ranges for a pattern of the standard library."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    runs = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True).pre_tokenize_str(every)
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in runs)


#: White space to the tokenizer, and runs of anything else.
SPACE = r" \t-\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = re.compile(f"[^{SPACE}]+")
#: Spaces of str.split that aren't white space to the tokenizer.
NOT_SPACE = "\x1c\x1d\x1e\x1f"


class Tokenizer:
    """A public word-level BPE file: cuts texts, encodes words by the transducer, remembers a bounded number of them."""

    def __init__(self, path: str, letter: str, digit: str, remembered: int = 900_000):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        special = {t["content"]: t["id"] for t in told["added_tokens"]}
        words = {t: k for t, k in model["vocab"].items() if t not in special}
        suffix = model["end_of_word_suffix"] or ""
        self.merges = Merges(words, [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]], suffix)
        self.special = {t: np.uint32(k).astype("<u4").tobytes() for t, k in special.items()}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        # The file's own pattern; letters and digits by their general categories.
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{SPACE}{letter}{digit}]+")
        # End of the fixed values.
        #: The library writes tokens as the vocabulary does, with spaces between; the other table has the bytes they stand for.
        self.surface = {k: t.encode() for t, k in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        self.bytes_of = {k: bytes([ord(c) % 256 for c in t]) + (b" " if ord(t[-1]) > 255 else b"") for t, k in self.merges.ids.items()} | {t["id"]: t["content"].encode() for t in told["added_tokens"]}
        self.library = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.assigned: set[str] = set()  # characters that this Python knows
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        self.transducer = Transducer(self.merges)

    def word_ids(self, word: str) -> bytes:
        """Ids of one word, as little-endian 32-bit numbers."""
        symbols = word.encode("utf-8", "surrogatepass").decode("latin-1")
        if self.merges.marked:
            symbols = symbols[:-1] + chr(ord(symbols[-1]) + 256)
        tokens = self.transducer.feed(symbols) + self.transducer.finish()
        return array("I", map(self.merges.ids.__getitem__, tokens)).tobytes()

    def run_ids(self, run: str) -> bytes:
        """Ids of a run without white space, which is one word or several; short ones are remembered."""
        words = self.word.findall(run)
        known = self.known
        if len(words) == 1 and words[0] == run:
            got = self.word_ids(run)
        else:
            got = b"".join([known.get(w) or self.run_ids(w) for w in words])
        if len(run) <= 64:
            if len(known) >= self.remembered:
                known.clear()
            known[run] = got
        return got

    def normal(self, text: str) -> str:
        """Normal form C, then lower case character by character (a final sigma is no special case)."""
        if not text.isascii():
            fresh = set(text) - self.assigned
            if any(unicodedata.category(c) == "Cn" for c in fresh):  # this Python's tables lack it
                return self.library.normalize_str(text)
            self.assigned |= fresh
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def pieces(self, text: str) -> Iterator[bytes]:
        """Ids of a text, run by run."""
        for k, part in enumerate(self.cut_special.split(text) if "<|" in text else (text,)):
            if k % 2:
                yield self.special[part]
                continue
            part, known = self.normal(part), self.known
            for run in RUN.findall(part) if any(c in part for c in NOT_SPACE) else part.split():
                yield known.get(run) or self.run_ids(run)

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.pieces(text)) if text else b""

    def decoder(self, plain: bool = False) -> Decoder:
        """As the library decodes, or (plain) to the lower-case text with a space behind each word."""
        return Decoder(self.bytes_of) if plain else Decoder(self.surface, b" ")


@cache
def load(path: str, letter: str, digit: str) -> Tokenizer:
    """The tokenizer of a Python worker; the classes of characters come from the driver, as finding them takes seconds."""
    return Tokenizer(path, letter, digit)


def classes() -> tuple[str, str]:
    return characters(r"\p{L}"), characters(r"\p{N}")


def encode_documents(docs: DataFrame, model: str = MODEL, decoded: bool = False, batch: int = 500) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian uint32) and, if asked for, `decoded`: the text that these ids give back."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), *([("decoded", pa.string())] if decoded else [])])

    letter, digit = classes()

    def begin():
        tokenizer = load(model, letter, digit)
        decoder = tokenizer.decoder()

        def work(part: pa.RecordBatch) -> dict:
            ids = [tokenizer.encode(t) for t in part.column("text").to_pylist()]
            out = {"doc_id": part.column("doc_id"), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}
            return out | {"decoded": [decoder.text(np.frombuffer(x, "<u4").tolist()) for x in ids]} if decoded else out

        return work

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, begin, batch)


def decode_documents(encoded: DataFrame, model: str = MODEL, plain: bool = False) -> DataFrame:
    """doc_id and text of ids as encode_documents gives them; null ids are an empty text."""

    letter, digit = classes()

    def begin():
        decoder = load(model, letter, digit).decoder(plain)

        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "text": [decoder.text(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column("ids").to_pylist()]}

        return work

    return in_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids")), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), begin, 500)


def digests(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text."""
    coded = encode_documents(docs, model, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
