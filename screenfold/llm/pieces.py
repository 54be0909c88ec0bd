"""Op 1: SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a text there is exactly one piece that the encoding of this prefix ends with.
Automaton matches propose the pieces that end at a position; the right one is the one that stays
apart from the last piece of the prefix before it when the two are merged as a pair. Walking the
table backwards gives the ids in linear time, without a heap of merges.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm.common import slices

SPACE = "▁"
#: Longest word whose ids are kept, so that a cache is bounded in bytes too.
LONGEST_KEPT = 64


class PieceCodec:
    """Encodes and decodes with the vocabulary of a merge-type (BPE) SentencePiece model.

    The library reads the model file; segmentation and decoding are done here. The normaliser must
    be the identity with a dummy prefix and byte fallback, which is checked by the tests.
    """

    def __init__(self, model_path: str, most: int = 180_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.score = {}
        self.id = {}
        self.byte_id = [0] * 256
        self.byte_of: dict[int, int] = {}
        self.silent = set()
        self.auto = ahocorasick.Automaton()
        for i, piece in enumerate(self.pieces):
            if sp.is_byte(i):
                self.byte_id[int(piece[1:-1], 16)] = i
                self.byte_of[i] = int(piece[1:-1], 16)
            elif sp.is_control(i):
                self.silent.add(i)
            elif not sp.is_unknown(i) and not sp.is_unused(i):
                self.score[piece] = sp.get_score(i)
                self.id[piece] = i
                self.auto.add_word(piece, (len(piece), i))
        self.auto.make_automaton()
        self.unknown = sp.unk_id()
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece spans words; chunks would not be independent")
        if any(c not in self.id for c in set("".join(self.id))):
            raise ValueError("a character occurs in pieces but is no piece itself")
        # two characters that no piece holds side by side never merge: texts may be cut between them
        self.joined = {p[i : i + 2] for p in self.id for i in range(len(p) - 1)}
        self.words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self.most = most
        self.pairs: dict[int, bool] = {}
        self.chunk_ids: dict[str, str] = {}
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd = False  # whether any word so far did not decode to itself

    def _merged(self, text: str) -> list[str]:
        """Greedy merges of a short text: the best score first, the leftmost of equals."""
        parts, score = list(text), self.score
        scores = [score.get(x + y) for x, y in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, s in enumerate(scores):
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = score.get(parts[at - 1] + parts[at])
            if at < len(scores):
                scores[at] = score.get(parts[at] + parts[at + 1])

    def compatible(self, left: int, right: int) -> bool:
        """Whether piece ``right`` after piece ``left`` stays as it is (left -1: at the start of the text)."""
        b = self.pieces[right]
        a = self.pieces[left] if left >= 0 else ""
        return self._merged(a + b) == ([a, b] if a else [b])

    def segment(self, text: str) -> list[int]:
        """Ids of a normalised text, by the table of each prefix's last piece.

        A character outside the vocabulary is its own last piece, given as -2 - its code point.
        """
        last = [-1] * (len(text) + 1)
        size = [1] * (len(text) + 1)
        done = 0  # prefixes up to here have their last piece
        pairs = self.pairs
        for at, (n, piece) in self.auto.iter(text):
            if at < done:
                continue
            if at > done:  # no piece ends there: unknown characters
                for i in range(done, at):
                    last[i + 1] = -2 - ord(text[i])
                done = at
            left = last[at + 1 - n]
            key = (left << 16) + piece if left >= 0 else -1 - piece
            ok = pairs.get(key)
            if ok is None:
                if len(pairs) >= 3 * self.most:
                    pairs.clear()
                ok = pairs[key] = self.compatible(left if left >= 0 else -1, piece)
            if ok:
                done = at + 1
                last[done] = piece
                size[done] = n
        for i in range(done, len(text)):
            last[i + 1] = -2 - ord(text[i])
        out, end = [], len(text)
        while end:
            out.append(last[end])
            end -= size[end]
        return out[::-1]

    def _ids(self, chunk: str) -> str:
        """Decimal ids of a chunk that no piece leaves, joined by commas."""
        got = self.chunk_ids.get(chunk)
        if got is None:
            out: list[int] = []
            for i in self.segment(chunk):
                if i >= 0:
                    out.append(i)
                else:
                    out += [self.byte_id[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]
            got = ",".join(map(str, out))
            if len(self.chunk_ids) >= self.most:
                self.chunk_ids.clear()
            self.chunk_ids[chunk] = got
        return got

    def _word(self, word: str) -> str:
        got = self.old.get(word)
        if got is None:
            parts, start, joined = [], 0, self.joined
            for i in range(1, len(word)):
                if word[i - 1 : i + 1] not in joined:
                    parts.append(word[start:i])
                    start = i
            parts.append(word[start:])
            ids = ",".join([self._ids(p) for p in parts])
            back = self._text([int(i) for i in ids.split(",")])
            got = ids if back == word.replace(SPACE, " ") else (ids, back)
            self.odd = self.odd or got is not ids
        if len(word) <= LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[word] = got
        return got

    def _words(self, text: str) -> list[str]:
        """Runs of spaces with what follows them; a text starts with one more."""
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return self.words(SPACE + text.replace(" ", SPACE))
        return [SPACE + w for w in text.split(" ")]

    def encoded(self, text: str | None) -> tuple[str, int, str]:
        """Decimal ids joined by commas, how many, and the text they decode to."""
        if not text:
            return "", 0, ""
        out = []
        words = self._words(text)
        young = self.young
        for w in words:
            got = young.get(w)
            if got is None:
                got = self._word(w)
                young = self.young
            out.append(got)
        # words begin with a space, so no run of bytes goes from one to the next and their decoded forms join
        if self.odd:
            back = "".join([w if g.__class__ is str else g[1] for w, g in zip(words, out)])
            ids = ",".join([g if g.__class__ is str else g[0] for g in out])
        else:
            back, ids = "".join(words), ",".join(out)
        back = back.replace(SPACE, " ")
        return ids, ids.count(",") + 1, back[1:] if back.startswith(" ") else back

    def encode(self, text: str | None) -> list[int]:
        ids = self.encoded(text)[0]
        return [int(i) for i in ids.split(",")] if ids else []

    def _text(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run.clear()
            out.append(" ⁇ " if i == self.unknown else "" if i in self.silent else self.pieces[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int]) -> str:
        back = self._text(ids)
        return back[1:] if back.startswith(" ") else back


@lru_cache(maxsize=2)
def codec(model_path: str) -> PieceCodec:
    return PieceCodec(model_path)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", keep_decoded: bool = True) -> DataFrame:
    """(id, ids array<int>, round_trips boolean[, decoded string]) of every row; a null text is an
    empty one.

    ``round_trips``: the ids decode to the text. Rows are independent: repeated rows and ids give
    repeated results, other columns are not read, an empty table gives an empty one, a very long text is cut
    where no piece can span. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model_path)
        for b in slices(batches, 200):
            texts = b.column(1).to_pylist()
            got = [c.encoded(t) for t in texts]
            ids = pa.array([np.array(g[0].split(","), dtype=np.int32) if g[0] else np.zeros(0, np.int32) for g in got], type=pa.list_(pa.int32()))
            columns = {"id": b.column(0), "ids": ids, "round_trips": pa.array([g[2] == (t or "") for g, t in zip(got, texts)], type=pa.bool_())}
            if keep_decoded:
                columns["decoded"] = pa.array([g[2] for g in got], type=pa.string())
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    schema = f"id {kind}, ids array<int>, round_trips boolean" + (", decoded string" if keep_decoded else "")
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)


def encode_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): what ``encode_texts`` returns, as digests.

    The digests are taken where the ids are made, so the id lists never leave the task.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = codec(model_path)
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for b in slices(batches, 200):
            got = [c.encoded(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([g[1] for g in got], type=pa.int64()), pa.array([sha(g[0]) for g in got], type=pa.string()), pa.array([sha(g[2]) for g in got], type=pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
