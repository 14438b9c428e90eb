"""SentencePiece (byte-pair) encoding and decoding by vectorised rounds of merges.

The library joins, in a whole text, the neighbouring pair whose piece has the
best score, the leftmost first, until no pair is a piece. No piece has a space
mark behind another character, and two characters that stand together in no
piece are never joined, so texts fall into words and words into segments that
can't influence each other. All segments of many words lie in flat arrays: a
round looks up the rank of every neighbouring pair, takes the least of each
segment, joins its occurrences from the left and closes the gaps; segments
without a pair leave the arrays.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from presswork.llm.common import byte_slices, text_of

SPACE = "▁"
_NONE = np.iinfo(np.int32).max
#: Bytes that are no UTF-8 are decoded as U+FFFD one by one.
codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


class PieceModel:
    """Ids of texts, and texts of ids, as the sentencepiece library has them for a byte-pair model.

    The library only reads the file: pieces, scores and kinds. The model must leave texts as they are (no normalisation, no
    stripping of spaces, a space mark put before the text), must have bytes for unknown characters and no pieces of the
    user's; any other is an error.
    """

    def __init__(self, path: str, cache: int = 500_000, cached_chars: int = 64, max_rounds: int = 400) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize("  ﬁ Å ") != f"{SPACE * 3}ﬁ{SPACE}Å{SPACE}":
            raise ValueError("only models without normalisation, with a space put before the text")
        self.size = sp.vocab_size()
        special = {i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(self.size)}
        if any(map(sp.is_unused, range(self.size))) or not any(map(sp.is_byte, range(self.size))):
            raise ValueError("only models with bytes and without unused pieces")
        pieces = {sp.id_to_piece(i): i for i in range(self.size) if not special[i]}
        self.byte_ids = np.zeros(256, np.int32)
        for b in range(256):
            self.byte_ids[b] = sp.piece_to_id(f"<0x{b:02X}>")
        self._read_merges(pieces, sp)
        self.plain = [b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        #: Whether every space mark begins a word, and a new line is a word of its own.
        self.parted = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in pieces)
        self.control = {i for i in range(self.size) if sp.is_control(i)}
        #: Ids whose text may begin with a space that is no space mark.
        self.strange = {int(self.byte_ids[32]), *(i for i in range(self.size) if sp.is_unknown(i))}
        self.cache, self.cached_chars, self.max_rounds = cache, cached_chars, max_rounds
        self._forget()

    def _read_merges(self, pieces: dict[str, int], sp: sentencepiece.SentencePieceProcessor) -> None:
        """Tables of symbols (pieces, and single characters that only stand in pieces), of pairs, and of neighbours."""
        symbols = dict(pieces)
        for p in list(pieces):
            for c in p:
                symbols.setdefault(c, self.size + len(symbols))
        chars = sorted(c for c in symbols if len(c) == 1)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbol_of[[ord(c) for c in chars]] = [symbols[c] for c in chars]
        self.char_of = np.zeros(0x110000, np.int32)  # 0 for characters of no piece
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: i + 1 for i, c in enumerate(chars)}
        self.side_by_side = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        scores = {p: sp.get_score(i) for p, i in pieces.items()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.base = max(symbols.values()) + 1
        merges, alone, of_rank = {}, np.ones(len(ranks), bool), np.zeros(len(ranks), np.int32)
        for p, i in pieces.items():
            for a, b in zip(p, p[1:]):
                self.side_by_side[number[a], number[b]] = True
            if len(p) == 1:
                continue
            rank = ranks[scores[p]]
            of_rank[rank] += 1
            for cut in range(1, len(p)):
                left, right = symbols.get(p[:cut]), symbols.get(p[cut:])
                if left is not None and right is not None:
                    merges[left * self.base + right] = (rank, i)
                    for part in (p[:cut], p[cut:]):
                        if len(part) > 1 and rank <= ranks[scores[part]]:
                            alone[ranks[scores[part]]] = False
        self.merges = merges
        self.pair_rank = np.array([r for r, _ in merges.values()] + [_NONE], np.int32)
        self.pair_piece = np.array([i for _, i in merges.values()] + [-1], np.int32)
        self._hash_pairs(np.array(list(merges), np.int64))
        #: Ranks after whose merge no pair of a better or equal rank can arise: all their occurrences may be joined at once.
        self.at_once = alone & (of_rank <= 1)

    def _hash_pairs(self, keys: np.ndarray) -> None:
        """An open-addressing table of the pairs, a quarter full at most: a key's place is at its hash or soon after it."""
        bits = int(4 * len(keys) - 1).bit_length()
        self.shift = np.uint64(64 - bits)
        self.slots = np.full((1 << bits) + 64, -1, np.int64)  # keys
        self.places = np.full((1 << bits) + 64, len(keys), np.int32)  # their numbers
        for number, (key, at) in enumerate(zip(keys.tolist(), self._hashed(keys).tolist())):
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.places[at] = key, number

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Numbers of pairs; the number after the last stands for no piece."""
        key = left.astype(np.int64) * self.base + right
        key[(left < 0) | (right < 0)] = -2
        at = self._hashed(key)
        found = self.slots[at]
        out = np.where(found == key, self.places[at], len(self.merges))
        more = np.flatnonzero((found != key) & (found >= 0))
        while len(more):
            at[more] += 1
            found = self.slots[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.places[at[more[hit]]]
            more = more[(found >= 0) & ~hit]
        return out

    def merged(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, places of their first characters) that are left of words, given as code points and where each word starts."""
        symbol, at = self.symbol_of[points], np.arange(len(points))
        chars = self.char_of[points]
        cut = np.ones(len(points), bool)
        cut[1:] = ~self.side_by_side[chars[:-1], chars[1:]]
        cut[starts] = True
        segment = np.cumsum(cut)
        done_symbols, done_at = [], []
        for _ in range(self.max_rounds):
            if not len(symbol):
                break
            pair = np.full(len(symbol), len(self.merges))
            inside = np.flatnonzero(segment[1:] == segment[:-1])
            pair[inside] = self._pairs(symbol[inside], symbol[inside + 1])
            rank = self.pair_rank[pair]
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
            sizes = np.diff(np.append(first, len(symbol)))
            least = np.repeat(np.minimum.reduceat(rank, first), sizes)
            over = least == _NONE
            if over.any():
                done_symbols.append(symbol[over])
                done_at.append(at[over])
            hit = np.flatnonzero((rank == least) & ~over)
            of = segment[hit]
            # Of occurrences that overlap every second goes, from the left; where a merge may bring a better pair, only the first stays.
            fresh = np.concatenate(([True], hit[1:] != hit[:-1] + 1))[: len(hit)]
            run = np.flatnonzero(fresh)
            odd = (np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))) & 1 == 1
            leftmost = np.concatenate(([True], of[1:] != of[:-1]))[: len(hit)]
            hit = hit[np.where(self.at_once[rank[hit]], ~odd, leftmost)]
            symbol = symbol.copy()
            symbol[hit] = self.pair_piece[pair[hit]]
            over[hit + 1] = True
            symbol, at, segment = symbol[~over], at[~over], segment[~over]
        # What so many rounds leave are long words of many different pairs, or of one repeated character: one by one in the same order.
        for s in np.unique(segment) if len(symbol) else ():
            mine = segment == s
            left, places = self._by_queue(symbol[mine].tolist(), at[mine].tolist())
            done_symbols.append(np.array(left, np.int32))
            done_at.append(np.array(places, np.int64))
        if not done_at:
            return symbol, at
        symbols, at = np.concatenate(done_symbols), np.concatenate(done_at)
        order = np.argsort(at)
        return symbols[order], at[order]

    def _by_queue(self, symbols: list[int], at: list[int]) -> tuple[list[int], list[int]]:
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def entry(i: int) -> tuple | None:
            j = after[i]
            if j >= n or symbols[i] < 0 or symbols[j] < 0:
                return None
            merge = self.merges.get(symbols[i] * self.base + symbols[j])
            return merge and (merge[0], i, symbols[i], symbols[j], merge[1])

        queue = [e for e in map(entry, range(n)) if e]
        heapify(queue)
        gone = [False] * n
        while queue:
            _, i, a, b, piece = heappop(queue)
            j = after[i]
            if gone[i] or j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], gone[j], after[i] = piece, True, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (e := entry(k)):
                    heappush(queue, e)
        stay = [i for i in range(n) if not gone[i]]
        return [symbols[i] for i in stay], [at[i] for i in stay]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word); unknown characters become their bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        starts = np.cumsum(sizes) - sizes
        ids, at = self.merged(points, starts[sizes > 0])
        unknown = (ids < 0) | (ids >= self.size)
        lengths = np.ones(len(ids), np.int64)
        if unknown.any():
            p = points[at[unknown]]
            lengths[unknown] = 1 + (p >= 0x80) + (p >= 0x800) + (p >= 0x10000)
            ids = np.repeat(ids, lengths)
            ids[np.repeat(unknown, lengths)] = self.byte_ids[np.frombuffer("".join(map(chr, p.tolist())).encode(), np.uint8)]
        before = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(before[np.append(np.searchsorted(at, starts), len(at))])

    def _forget(self) -> None:
        """Of the words known so far: their numbers, their ids in a row, and where each word's ids start and how many they are."""
        self.known: dict[str, int] = {}
        self.ids, self.start, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        new = [w for w in words if w not in self.known]
        if new:
            ids, count = self.word_ids(new)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(count) - count)
            self.ids, self.count = np.append(self.ids, ids), np.append(self.count, count)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        return np.array([self.known[w] for w in words], np.int64)

    def words(self, texts: pa.Array) -> pa.ListArray:
        """The words of each text: a new one starts at every run of space marks, and new lines stand alone."""
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if not pc.any(pc.match_substring(texts, c)).as_py())
        marked = pc.binary_join_element_wise(SPACE, pc.replace_substring(texts, " ", SPACE), "")
        if self.parted:
            spaced = pc.replace_substring(pc.replace_substring(marked, SPACE, mark + SPACE), SPACE + mark, SPACE)
            marked = pc.replace_substring(spaced, "\n", f"{mark}\n{mark}")
        return pc.split_pattern(marked, mark)

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text. Words are merged once for all these texts and kept for the next, up to ``cache`` words in all."""
        if len(self.known) > self.cache or len(self.ids) > self.cached_chars * self.cache:
            self._forget()
        words = self.words(texts)
        coded = words.flatten().dictionary_encode()
        number = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        count = self.count[number]
        before = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.arange(before[-1]) + np.repeat(self.start[number] - before[:-1], count)]
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        bounds = before[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if empty.any():  # an empty text has no ids, not even that of its space mark
            lengths = np.diff(bounds)
            ids = ids[~np.repeat(empty, lengths)]
            bounds = np.concatenate(([0], np.cumsum(np.where(empty, 0, lengths))))
        return pa.ListArray.from_arrays(bounds.astype(np.int32), ids)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: pieces in a row, without the space mark that stands before the text. Bytes on both sides of a
        begin or end id don't make one character."""
        parts = list(map(self.plain.__getitem__, ids))
        first = next((i for i, p in enumerate(parts) if p), None)
        if first is not None and parts[first][:1] == b" " and ids[first] not in self.strange:
            parts[first] = parts[first][1:]
        if self.control.isdisjoint(ids):
            return b"".join(parts).decode("utf-8", "each_byte")
        ends = [i for i, x in enumerate(ids) if x in self.control]
        return "".join(b"".join(parts[x:y]).decode("utf-8", "each_byte") for x, y in zip([0, *ends], [*ends, len(ids)]))


@lru_cache(maxsize=2)
def model_of(name: str) -> PieceModel:
    """The process's model for a file of ``public_tokenizers``, or for a path."""
    return PieceModel(name if "/" in name else public_tokenizers.path(name))


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text without begin and end ids.

    Null and empty texts have no ids. Rows count each for themselves, repeated and null ids too; an empty table gives an
    empty result; other columns are left out. Nothing is shuffled: texts go through in slices of some 4 MB,
    so that a task's memory follows its longest text.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(model)
        for batch in batches:
            texts = batch.column("text")
            for x, y in byte_slices(pc.binary_length(texts).to_pylist(), 4_000_000):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(x, y - x), pieces.encode(texts.slice(x, y - x))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, text) of every row of (doc_id, ids): the text of its ids, and the digest of the ids in
    decimal joined by commas. Null ids are none. Ids outside the vocabulary are an error, as in the library."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("text", pa.large_string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model_of(model)
        decimal = [str(i).encode() for i in range(pieces.size)]
        for batch in batches:
            lists = batch.column("ids")
            bounds = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy()))).tolist()
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            for x, y in byte_slices(np.diff(bounds).tolist(), 1_000_000):
                rows = [ids[i:j].tolist() for i, j in zip(bounds[x:y], bounds[x + 1 : y + 1])]
                digests = [hashlib.sha256(b",".join(map(decimal.__getitem__, r))).hexdigest() for r in rows]
                columns = [batch.column("doc_id").slice(x, y - x), pa.array([len(r) for r in rows], pa.int64()), pa.array(digests, pa.string()), pa.array([pieces.decode(r) for r in rows], pa.large_string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, text string")
