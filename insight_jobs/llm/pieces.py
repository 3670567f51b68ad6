"""SentencePiece encoding and decoding with a shared-prefix forward pass.

A text is marked (each space becomes the mark, one mark goes first) and cut before each run of marks: no piece crosses
such a border. The distinct marked words of a batch are sorted, which lays them out as the depth-first walk of their
trie; a word starts from the forward states of the prefix that it shares with the word before, so each trie node is
computed once.

The forward state of a prefix is its best score and the last piece of the best path (Viterbi). Models of two kinds differ
in the transitions: under a unigram model any piece may follow any other. Under a merge (BPE) model a piece may follow
another only if the merge procedure leaves the two as they are; the largest sum over all paths isn't what the public
library returns, but with this rule one path alone is admissible, and it is the library's. So the search of a prefix ends
with the first admissible piece. Characters without a piece fall back to their bytes.

Null and empty texts have no pieces and decode to an empty text. Very long texts are encoded whole; equal rows have
equal results, with or without doc_id. Extra columns are ignored.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Score of a character without a piece.
UNKNOWN = -100_000.0
#: The length of a piece of two characters, for places where no longer piece ends.
PAIR = (2,)
WORD = re.compile(f"{MARK}+[^{MARK}]*")


class Pieces:
    """A model's pieces, scores and byte ids; `merging`: a BPE model."""

    def __init__(self, scores: dict[str, float], ids: dict[str, int], bytes_at: list[int], merging: bool, unknown: int = 0):
        self.scores, self.ids, self.bytes_at, self.merging, self.unknown = scores, ids, bytes_at, merging, unknown
        self.longest = max(map(len, scores), default=1)
        ends: dict[str, set[int]] = {}
        for p in scores:
            if len(p) > 2:
                ends.setdefault(p[-3:], set()).add(len(p))
        #: Lengths of the pieces that end in three given characters, longest first, and that of a pair.
        self.lengths = {e: (*sorted(n, reverse=True), 2) for e, n in ends.items()}
        self.fits: dict[tuple[str, str], bool] = {}
        #: Ids and bytes of words that this Python worker has met; they outlast its tasks.
        self.ids_of: dict[str, bytes] = {}
        self.raw_of: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """The merge procedure itself: the best-scored neighbours first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            found = [(-self.scores[p], k) for k in range(len(parts) - 1) if (p := parts[k] + parts[k + 1]) in self.scores]
            if not found:
                break
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def fit(self, left: str, right: str) -> bool:
        """Whether the merge procedure leaves the two as they are; kept in `fits`."""
        if len(self.fits) >= 1_000_000:
            self.fits.clear()
        known = self.fits[left, right] = self.merged(left + right) == [left, right]
        return known

    def forward(self, word: str, best: list[float], last: list[str]) -> None:
        """Extend the states of a prefix (best[i], last[i]: of the first i characters) to the whole word."""
        scores, lengths, fits = self.scores, self.lengths, self.fits
        for i in range(len(best), len(word) + 1):
            top, chosen = best[i - 1] + scores.get(word[i - 1], UNKNOWN), word[i - 1]
            if not self.merging:
                for n in range(1, min(self.longest, i) + 1):
                    piece = word[i - n : i]
                    score = scores.get(piece, -np.inf) + best[i - n]
                    if score > top:
                        top, chosen = score, piece
            else:
                for n in lengths.get(word[i - 3 : i], PAIR) if i > 2 else PAIR:
                    if n > i:
                        continue
                    piece = word[i - n : i]
                    if piece in scores:
                        fit = n == i or fits.get((last[i - n], piece))
                        if fit or (fit is None and self.fit(last[i - n], piece)):
                            top, chosen = best[i - n] + scores[piece], piece
                            break
            best.append(top)
            last.append(chosen)

    def pieces(self, last: list[str]) -> list[str]:
        out, i = [], len(last) - 1
        while i > 0:
            p = last[i]
            out.append(p)
            i -= len(p)
        out.reverse()
        return out

    def numbers(self, pieces: list[str]) -> list[int]:
        out = list(map(self.ids.get, pieces))
        if None not in out:
            return out
        out = []
        for p in pieces:
            k = self.ids.get(p)
            out.extend([k] if k is not None else [self.bytes_at[b] for b in p.encode("utf-8", "surrogatepass")] if self.bytes_at else [self.unknown])
        return out

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Ids of distinct words, in sorted order; states of shared prefixes are computed once."""
        before, best, last = "", [0.0], [""]
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], last[shared + 1 :]
            self.forward(word, best, last)
            before = word
            yield word, self.numbers(self.pieces(last))


@cache
def load(path: str, merging: bool = True) -> Pieces:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    plain = {model.id_to_piece(k): k for k in every if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))}
    return Pieces({p: model.get_score(k) for p, k in plain.items()}, plain, [k for k in every if model.is_byte(k)], merging, model.unk_id())


def marked_words(text: str) -> list[str]:
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Decoder:
    """Ids back to text; runs of byte pieces are decoded together."""

    def __init__(self, pieces: Pieces):
        self.raw = {k: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, k in pieces.ids.items()}
        self.raw |= {k: bytes([b]) for b, k in enumerate(pieces.bytes_at)}

    def text(self, ids: Iterable[int]) -> str:
        """The text; ids that are no pieces add nothing. The first space is the mark that every text begins with."""
        return b"".join([self.raw.get(k, b"") for k in ids]).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str = MODEL, batch: int = 1000, remembered: int = 900_000) -> DataFrame:
    """doc_id, n_pieces, ids (binary, little-endian uint16), decodes: whether the decoder gives the very text back.

    A text that has the mark itself decodes to spaces in its place, as in the public library, so that `decodes` is false.
    remembered: words that a Python worker keeps from batch to batch, in memory alone; the result doesn't hang on it.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids", pa.binary()), ("decodes", pa.bool_())])

    def begin():
        pieces, decoder, little = load(model), Decoder(load(model)), sys.byteorder == "little"
        ids_of, raw_of = pieces.ids_of, pieces.raw_of

        def work(part: pa.RecordBatch) -> dict:
            texts = [t or "" for t in part.column("text").to_pylist()]
            words = [marked_words(t) for t in texts]
            here = set().union(*words)
            fresh = here - ids_of.keys()
            if len(ids_of) + len(fresh) > remembered:
                ids_of.clear()
                raw_of.clear()
                fresh = here
            for word, ids in pieces.encode_words(fresh):
                ids_of[word] = array("H", ids).tobytes() if little else np.array(ids, "<u2").tobytes()
                raw_of[word] = b"".join([decoder.raw.get(k, b"") for k in ids])
            ids = [b"".join(map(ids_of.__getitem__, ws)) for ws in words]
            decodes = [b"".join(map(raw_of.__getitem__, ws))[1:] == t.encode("utf-8", "surrogatepass") for t, ws in zip(texts, words, strict=True)]
            return {"doc_id": part.column("doc_id"), "n_pieces": [len(x) // 2 for x in ids], "ids": ids, "decodes": decodes}

        return work

    return in_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), schema, begin, batch)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of ids as encode_documents gives them."""

    def begin():
        decoder = Decoder(load(model))

        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "text": [decoder.text(np.frombuffer(x or b"", "<u2").tolist()) for x in batch.column("ids").to_pylist()]}

        return work

    return in_batches(encoded.select(F.col("doc_id").cast("long"), F.col("ids")), pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), begin)
