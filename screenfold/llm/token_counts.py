"""Op 3: exact token counts by a compiled finite-state tokenizer.

Merges are compiled, state by state as texts ask for them, into a deterministic transducer over the
symbols of a word whose transitions carry the number of tokens that they add; a machine over characters
cuts words around it. White space resets the machine whatever state it is in, so the map of a chunk
from entry state to exit state and count is known but for what it does before its first white space:
the tokens emitted from there on, and the exit state. Composing two maps runs the second's beginning
from the first's exit state. A text is cut into chunks of fixed size and their maps are combined by a
work-efficient prefix scan; Spark's tasks do this for many texts side by side. Texts of one chunk need
no maps: each distinct stretch between their white space runs through the machine once a batch.
"""

from __future__ import annotations

import json
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from screenfold.llm.common import slices

#: The characters that the tokenizer's normaliser takes as white space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: Fixed value: the pattern of the tokenizer's words, with its class of white space spelled out.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + BLANKS + r"\p{L}\p{N}]+"

#: Those of them at which texts are cut.
ASCII_BLANKS = set("\t\n\x0b\x0c\r ")

#: The contractions among those words.
CONTRACTIONS = set("'s 't 're 've 'm 'll 'd".split())

#: Lower-case forms that str.lower() lacks or gives by context (final sigma).
LOWER = {0x03A3: 0x03C3, 0xA7CB: 0x0264, 0xA7DC: 0x019B}


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordTransducer:
    """Deterministic transducer over the bytes of one word; each transition adds tokens to a count.

    A state holds, for every start from which the symbols read so far may still grow into one token,
    the trie node reached, the last token before that start, and how many tokens fewer than now there
    were then. Reading a symbol advances the nodes; the one token that ends here and stays apart from
    its predecessor gives the new prefix's count.
    """

    def __init__(self, merges: list, vocab: dict, suffix: str, most: int = 150_000):
        self.rank = {(a, b): i for i, (a, b) in enumerate(merges)}
        self.suffix, self.most = suffix, most
        self.symbol = byte_symbols()
        self.trie: list[dict[str, int]] = [{}]
        self.token_at: list[tuple[str, ...] | None] = [None]
        tokens = {s: (s,) for b in self.symbol for s in (b, b + suffix)}
        self.made: dict[str, tuple[str, str, int]] | None = {}  # parts and rank of each merge's token
        for i, (a, b) in enumerate(merges):
            if self.made is not None and a in tokens and b in tokens and a + b not in tokens:
                self.made[a + b] = (a, b, i)
            else:
                self.made = None  # parts made later, or a token made twice: the order of ranks says nothing
            if a in tokens and b in tokens:
                tokens.setdefault(a + b, tokens[a] + tokens[b])
        for symbols in tokens.values():
            node = 0
            for s in symbols:
                nxt = self.trie[node].get(s)
                if nxt is None:
                    nxt = self.trie[node][s] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(None)
                node = nxt
            self.token_at[node] = symbols
        self.pairs: dict[tuple[int, int], bool] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.reset()

    def reset(self) -> None:
        self.states: dict[tuple, int] = {}
        self.content: list[tuple] = []
        self.moves: list[dict] = []
        self.start = self._state(self.begin)

    def _state(self, content: tuple) -> int:
        got = self.states.get(content)
        if got is None:
            got = self.states[content] = len(self.content)
            self.content.append(content)
            self.moves.append({})
        return got

    def merged(self, symbols: tuple[str, ...]) -> list[str]:
        """Merges by rank, the leftmost of equals first."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 30) for p in zip(parts, parts[1:])]
            best = min(ranks)
            if best == 1 << 30:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _apart(self, left: int, right: int) -> bool:
        """Whether the token of trie node ``right`` stays as it is after that of ``left`` (0: none)."""
        got = self.pairs.get((left, right))
        if got is None:
            if len(self.pairs) >= 2 * self.most:
                self.pairs.clear()
            got = self.pairs[left, right] = self._stays(left, right)
        return got

    def _stays(self, left: int, right: int) -> bool:
        """``_apart`` without its cache.

        Where a token's parts have lower ranks than itself, merges come in the order of ranks, and two
        tokens that hold by themselves evolve apart until a pair of their edges merges: when both parts
        are there, before the left one is taken (at the same rank the left token's own merge comes
        first) and not after the right one is.
        """
        a, b = self.token_at[left] or (), self.token_at[right]
        if not a or self.made is None:
            return self.merged(a + b) == (["".join(a)] if a else []) + ["".join(b)]
        if not (self._apart(0, left) and self._apart(0, right)):
            return False
        rank, firsts = self.rank, self._edge(right, 0)
        for x, x_until in self._edge(left, 1):
            for y, y_until in firsts:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    return False
        return True

    def _edge(self, node: int, side: int) -> list[tuple[str, int]]:
        """What stands at the first (0) or last (1) place of a token while it is merged, and the rank that takes it."""
        got = self.edges[side].get(node)
        if got is None:
            part, until, got = "".join(self.token_at[node]), 1 << 30, []
            while part is not None:
                got.append((part, until))
                made = self.made.get(part)
                part, until = (made[side], made[2]) if made else (None, 0)
            self.edges[side][node] = got
        return got

    def _move(self, state: int, symbol: str) -> tuple[int, int]:
        """Compile one transition: the next state and the tokens it adds. A word with too many states
        drops those it has passed."""
        if len(self.content) > self.most:
            held = self.content[state]
            self.reset()
            state = self._state(held)
        live, found, added = [], 0, 0
        trie, token_at, pairs = self.trie, self.token_at, self.pairs
        for node, last, fewer in self.content[state]:
            nxt = trie[node].get(symbol)
            if nxt is not None:
                live.append((nxt, last, fewer))
                if not found and token_at[nxt]:
                    stays = pairs.get((last, nxt))
                    if stays or stays is None and self._apart(last, nxt):
                        found, added = nxt, 1 - fewer
        if added:
            live = [(n, last, fewer + added) for n, last, fewer in live]
        live.append((0, found, 0))
        got = self.moves[state][symbol] = (self._state(tuple(live)), added)
        return got

    #: Content of the state that a word begins in.
    begin = ((0, 0, 0),)

    def moved(self, content: tuple, symbol: str) -> tuple[tuple, int]:
        """``_move`` by what states hold, which stays valid when numbers are dropped."""
        state = self._state(content)
        nxt, added = self.moves[state].get(symbol) or self._move(state, symbol)
        return self.content[nxt], added

    def count(self, word: bytes) -> int:
        """Tokens of a whole word: transitions over its bytes, the last with the end-of-word mark."""
        if len(self.content) > self.most:
            self.reset()
        state, total, symbol = self.start, 0, self.symbol
        for b in word[:-1]:
            s = symbol[b]
            got = self.moves[state].get(s) or self._move(state, s)
            state = got[0]
            total += got[1]
        s = symbol[word[-1]] + self.suffix
        return total + (self.moves[state].get(s) or self._move(state, s))[1]


#: Longest stretch whose count is kept, so that a cache is bounded in bytes too.
LONGEST_KEPT = 64


#: Where the machine is: between words; in a run of letters or of other signs; or at an apostrophe, or an
#: apostrophe and a letter, that may become a contraction.
FREE, LETTERS, SIGNS, APOSTROPHE = "free", "letters", "signs", "apostrophe"
START = (FREE, None, None)


@dataclass(frozen=True)
class ChunkMap:
    """Map of a chunk from entry state to (exit state, count).

    ``head`` is what stands before the first white space and is run from whatever state the chunk is
    entered in; then ``emitted`` tokens and the state ``exit``, whatever the entry. Without white space
    ``exit`` is None and the whole chunk is head.
    """

    head: str
    emitted: int
    exit: tuple | None


class Recent:
    """Counts of strings met of late: at most ``most`` young ones, and the generation before them."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key: str) -> int | None:
        got = self.young.get(key)
        if got is None:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key: str, n: int) -> int:
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.old, self.young = self.young, {}
            self.young[key] = n
        return n


class TokenCounter:
    def __init__(self, tokenizer_json: str, chunk_chars: int = 1 << 16, most: int = 250_000):
        with open(tokenizer_json, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.fst = WordTransducer(merges, model["vocab"], model["end_of_word_suffix"] or "")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True))) if special else None
        self.words = regex.compile(WORDS).findall
        self.blank = regex.compile(f"[{BLANKS}]+")
        self.chunk_chars = chunk_chars
        self.apart = not any(set(s) & ASCII_BLANKS for s in special)
        self.clean, self.raw = Recent(most), Recent(most)  # words and stretches after and before normalisation
        self.kinds: dict[str, str] = {}

    def normal(self, text: str) -> str:
        if text.isascii():
            return self.blank.sub(" ", text).lower()
        text = unicodedata.normalize("NFC", text)
        # character by character: no final-sigma rule
        return self.blank.sub(" ", text).translate(LOWER).lower()

    def run(self, stretch: str) -> int:
        """Tokens of a stretch without white space, entered and left in the reset state."""
        got = self.clean.get(stretch)
        if got is None:
            words, got = self.words(stretch), 0
            for w in words:
                n = self.clean.get(w) if len(words) > 1 else None
                got += self.clean.put(w, self.fst.count(w.encode("utf-8", "surrogatepass"))) if n is None else n
            self.clean.put(stretch, got)
        return got

    def _kind(self, ch: str) -> str:
        got = self.kinds.get(ch)
        if got is None:
            got = self.kinds[ch] = "L" if regex.match(r"\p{L}", ch) else "N" if regex.match(r"\p{N}", ch) else "S"
        return got

    def _into(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """A character more in the word that ``state`` is in: its last byte waits, as it may end the word."""
        mode, content, waiting = state
        fst, added = self.fst, 0
        for b in ch.encode("utf-8", "surrogatepass"):
            if waiting is not None:
                content, n = fst.moved(content, fst.symbol[waiting])
                added += n
            waiting = b
        return (mode, content, waiting), added

    def _end(self, state: tuple) -> int:
        """Tokens that the end of the word, or of white space after it, adds."""
        mode, content, waiting = state
        if mode == FREE:
            return 0
        if mode == APOSTROPHE:  # no contraction: a sign, and the letter that had followed
            return sum(self.run(w) for w in waiting)
        return self.fst.moved(content, self.fst.symbol[waiting] + self.fst.suffix)[1]

    def step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """(state, tokens added) after one more character that is no white space."""
        mode, _, waiting = state
        kind = self._kind(ch)
        if mode == APOSTROPHE:
            if "".join(waiting) + ch in CONTRACTIONS:
                return START, self.run("".join(waiting) + ch)
            if len(waiting) == 1 and ch in "rvl":
                return (APOSTROPHE, None, ("'", ch)), 0
            if len(waiting) == 1 and kind == "S":
                state, n = self._into((SIGNS, self.fst.begin, None), "'")
                state, m = self._into(state, ch)
                return state, n + m
            before = self.run("'")
            state = START
            if len(waiting) == 2:
                state, n = self._into((LETTERS, self.fst.begin, None), waiting[1])
                before += n
            state, n = self.step(state, ch)
            return state, before + n
        if (mode, kind) in ((LETTERS, "L"), (SIGNS, "S")):
            return self._into(state, ch)
        before = self._end(state)
        if kind == "N":
            return START, before + self.run(ch)
        if ch == "'":
            return (APOSTROPHE, None, ("'",)), before
        state, n = self._into((LETTERS if kind == "L" else SIGNS, self.fst.begin, None), ch)
        return state, before + n

    def walk(self, state: tuple, stretch: str) -> tuple[tuple, int]:
        """(state, tokens added) after a stretch without white space."""
        total = 0
        for ch in stretch:
            state, n = self.step(state, ch)
            total += n
        return state, total

    def ended(self, state: tuple, stretch: str) -> int:
        """Tokens added by a stretch and the white space after it."""
        if state == START:
            return self.run(stretch) if stretch else 0
        state, n = self.walk(state, stretch)
        return n + self._end(state)

    def chunk_map(self, chunk: str) -> ChunkMap:
        stretches = chunk.split(" ")
        if len(stretches) == 1:
            return ChunkMap(chunk, 0, None)
        exit_, added = self.walk(START, stretches[-1])
        return ChunkMap(stretches[0], self._between(stretches[1:-1]) + added, exit_)

    def _between(self, stretches: list[str]) -> int:
        young, run = self.clean.young, self.run
        total = 0
        for s in stretches:
            if s:
                got = young.get(s)
                if got is None:
                    got = run(s)
                    young = self.clean.young
                total += got
        return total

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``; associative."""
        if a.exit is None:
            return ChunkMap(a.head + b.head, b.emitted, b.exit)
        if b.exit is None:
            exit_, added = self.walk(a.exit, b.head)
            return ChunkMap(a.head, a.emitted + added, exit_)
        return ChunkMap(a.head, a.emitted + self.ended(a.exit, b.head) + b.emitted, b.exit)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Inclusive prefix scan: neighbours are composed, their scan is made, and maps between fill in;
        the compositions of a level do not depend on each other."""
        if len(maps) < 2:
            return maps
        pairs = self.scan([self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])])
        return [maps[0]] + [pairs[i // 2] if i % 2 else self.compose(pairs[i // 2 - 1], maps[i]) for i in range(1, len(maps))]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        total, parts = 0, [text]
        if self.special and "<|" in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        for part in parts:
            if part:
                clean, n = self.normal(part), self.chunk_chars
                if len(clean) <= n:
                    total += self._between(clean.split(" "))
                    continue
                whole = self.scan([self.chunk_map(clean[i : i + n]) for i in range(0, len(clean), n)])[-1]
                total += self.ended(START, whole.head) + whole.emitted + (self._end(whole.exit) if whole.exit else 0)
        return total

    def fresh(self, stretch: str) -> int:
        """``count`` of a stretch without ASCII white space; most need no normaliser but lower case."""
        if not stretch.isascii() or "<|" in stretch:
            return self.count(stretch)
        clean, total = stretch.lower(), 0
        for w in (clean,) if clean.isalpha() else self.words(clean):
            n = self.clean.young.get(w)
            if n is None:
                n = self.clean.old.get(w)
                self.clean.put(w, n := self.fst.count(w.encode()) if n is None else n)
            total += n
        return total

    def counts(self, texts: pa.Array) -> np.ndarray:
        """``count`` of each text. Texts of one chunk are cut at their ASCII white space, which resets the
        machine and neither joins nor leaves a character in normalisation, and each distinct stretch
        between is counted once."""
        short = pc.fill_null(pc.less_equal(pc.utf8_length(texts), self.chunk_chars if self.apart else 0), True).to_numpy(zero_copy_only=False)
        stretches = pc.ascii_split_whitespace(pc.fill_null(texts.filter(pa.array(short)), ""))
        coded = stretches.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        counts = list(map(self.raw.young.get, words))
        for k, n in enumerate(counts):
            if n is None:
                word = words[k]
                n = self.raw.old.get(word)
                counts[k] = self.raw.put(word, self.fresh(word) if n is None else n)
        upto = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[coded.indices.to_numpy()])])
        at = stretches.offsets.to_numpy() - stretches.offsets[0].as_py()
        totals = np.zeros(len(texts), np.int64)
        totals[short] = upto[at[1:]] - upto[at[:-1]]
        for k in np.flatnonzero(~short):
            totals[k] = self.count(texts[int(k)].as_py())
        return totals


@lru_cache(maxsize=2)
def counter(tokenizer_json: str) -> TokenCounter:
    return TokenCounter(tokenizer_json)


def count_tokens(docs: DataFrame, tokenizer_json: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; a null or empty text has none of either.

    Very long texts are read chunk by chunk, and a word of any length leaves a bounded number of states. Rows are independent: repeated rows give repeated results, other columns are not read, an empty
    table gives an empty one. No shuffle; one pass over the text column.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(tokenizer_json)
        for b in slices(batches, 10_000):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(c.counts(b.column(2)), type=pa.int64())], ["id", "n_bytes", "n_tokens"])

    got = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    out = got.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
