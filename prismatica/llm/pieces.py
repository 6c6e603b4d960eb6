"""SentencePiece encoding by a streaming Viterbi search, and decoding.

The best sequence of vocabulary pieces is found from left to right. Only the last boundaries
that a piece can still start from are live; whenever the backpointers of all live boundaries
meet in one place, the ids before it are final and leave the window. The window is thus
bounded by the longest piece and the distance to the last meeting place, not by the text.
No piece holds a word mark after another character, so paths always meet before a mark; the
search between two such places is remembered for repeated words.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import ship, whole_text

ship(sys.modules[__name__])

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED, LONGEST_REMEMBERED = 100_000, 64


def load_pieces(path: str = MODEL) -> dict:
    """Pieces, scores and kinds of a model file, read on the driver; a vocabulary is a file of
    fixed size, so it is sent with the tasks. Merge models hold ranks in place of log
    probabilities; there a piece gets the one that Zipf's law gives its rank."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain, pieces, ranks = {}, [], all(model.get_score(i) == int(model.get_score(i)) for i in range(n))
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            pieces.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            pieces.append(piece.replace(MARK, " ").encode())
            score = model.get_score(i)
            plain[piece] = (-math.log(2.0 - score) if ranks else score, i)
    first = model.piece_to_id("<0x00>")
    lowest = min(s for s, _ in plain.values())
    return {"plain": plain, "bytes": pieces, "first_byte": first, "byte_score": lowest - 10.0}


class Trie:
    """Pieces by their characters, for lookups of many places at once: an edge is a node and a character's
    number, all edges lie sorted in one array."""

    def __init__(self, plain: dict[str, tuple[float, int]]):
        alphabet = sorted({c for p in plain for c in p})
        #: Number of each character; 0 is any other.
        self.number = np.zeros(0x110000, np.int32)
        self.number[[ord(c) for c in alphabet]] = np.arange(1, len(alphabet) + 1)
        numbers = {c: i + 1 for i, c in enumerate(alphabet)}
        self.width, nodes = len(alphabet) + 1, {"": 0}
        for p in plain:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes))
        kind = np.int32 if len(nodes) * self.width < 2**31 else np.int64
        edges = np.array([nodes[p[:-1]] * self.width + numbers[p[-1]] for p in nodes if p], kind)
        order = np.argsort(edges)
        self.edges, self.child = edges[order], np.array([n for p, n in nodes.items() if p], kind)[order]
        self.score, self.id = np.full(len(nodes), -np.inf), np.full(len(nodes), -1, np.int64)
        self.single = np.zeros(self.width, bool)
        for p, (score, i) in plain.items():
            self.score[nodes[p]], self.id[nodes[p]] = score, i
            if len(p) == 1:
                self.single[numbers[p]] = True

    def pieces(self, codes: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, score, id) of every piece in a run of characters; ``stops`` gives for each
        character the end of its word, which no piece crosses."""
        codes = self.number[codes]
        start, node, length, found = np.arange(len(codes)), np.zeros(len(codes), self.edges.dtype), 0, []
        while len(start):
            wanted = node * self.edges.dtype.type(self.width) + codes[start + length]
            at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            there = self.edges[at] == wanted
            start, node, length = start[there], self.child[at[there]], length + 1
            piece = self.id[node] >= 0
            found.append((start[piece], start[piece] + length, self.score[node[piece]], self.id[node[piece]]))
            inside = start + length < stops[start]
            start, node = start[inside], node[inside]
        return tuple(np.concatenate(x) for x in zip(*found))


class Encoder:
    def __init__(self, vocabulary: dict):
        self.plain, self.first_byte, self.byte_score = vocabulary["plain"], vocabulary["first_byte"], vocabulary["byte_score"]
        self.bytes = vocabulary["bytes"]
        self.longest = max(map(len, self.plain))
        self.sizes = [1] * (len(self.bytes) + 1)  # in characters; the last one is a character in bytes
        for p, (_, i) in self.plain.items():
            self.sizes[i] = len(p)
        #: Every beginning of a piece, with score and id where it is one.
        self.starts: dict[str, tuple[float, int] | None] = {p[:n]: None for p in self.plain for n in range(1, len(p))} | self.plain
        inner = any(MARK in p.lstrip(MARK) for p in self.plain)
        self.parts = None if inner else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, bytes] = {}
        self.trie = Trie(self.plain)
        self.length = np.array(list(map(len, self.bytes)))
        self.begin, self.letters = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(self.bytes), np.uint8)
        self.mark = np.array([self.first_byte + b for b in self._raw(MARK)], np.int32).tobytes()

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Ids of a string in final order, as they become final."""
        n, starts, longest, none = len(chars), self.starts.get, self.longest, -math.inf
        window = min(n, 5 * longest)
        best, piece = [0.0] + [none] * window, [0] * (window + 1)  # of the boundaries from ``base`` on
        base = ahead = 0  # ahead: the furthest end of a piece that starts before the current place
        for i in range(n):
            at = i - base
            here = best[at]
            end, single = i, False
            while end < n:
                end += 1
                found = starts(chars[i:end], 0)
                if found:
                    score, j = here + found[0], end - base
                    if score > best[j]:
                        best[j], piece[j] = score, found[1]
                    if end > ahead:
                        ahead = end
                    if end == i + 1:
                        single = True
                elif found == 0:
                    break
            if not single:
                cost = here + self.byte_score * len(self._raw(chars[i]))
                if cost > best[at + 1]:
                    best[at + 1], piece[at + 1] = cost, -1
                if ahead <= i:
                    ahead = i + 1
            if at >= 3 * longest and n - base > window:
                meeting = self._meeting(at + 1, ahead - base, best, piece)
                if meeting:
                    yield self._ids(chars, base, meeting, piece)
                    best, piece, base = best[meeting:] + [none] * meeting, piece[meeting:] + [0] * meeting, base + meeting
                elif ahead - base + longest >= len(best):
                    best, piece = best + [none] * window, piece + [0] * window
        if n > base:
            yield self._ids(chars, base, n - base, piece)

    @staticmethod
    def _raw(char: str) -> bytes:
        return char.encode("utf-8", "surrogatepass")

    def _meeting(self, low: int, high: int, best: list, piece: list) -> int:
        """The last boundary on the backpointer paths of all live boundaries, low to high."""
        live = {j for j in range(low, high + 1) if best[j] > -math.inf}
        while len(live) > 1:
            last = max(live)
            live.remove(last)
            live.add(last - self.sizes[piece[last]])
        return live.pop()

    def _ids(self, chars: str, base: int, end: int, piece: list) -> list[int]:
        out, sizes = [], self.sizes
        while end > 0:
            p = piece[end]
            if p >= 0:
                out.append(p)
            else:
                out.extend(self.first_byte + b for b in reversed(self._raw(chars[base + end - 1])))
            end -= sizes[p]
        out.reverse()
        return out

    def _part(self, part: str) -> bytes:
        found = self.known.get(part)
        if found is None:
            found = b"".join(np.array(ids, np.int32).tobytes() for ids in self.stream(part))
            if len(part) <= LONGEST_REMEMBERED:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[part] = found
        return found

    def learn(self, parts: set[str]) -> None:
        """Search all short ``parts`` that are not remembered, side by side: step t decides the boundary after
        character t of every one of them."""
        words = [p for p in parts if len(p) <= LONGEST_REMEMBERED and p not in self.known]
        if not words:
            return
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
            words = [p for p in parts if len(p) <= LONGEST_REMEMBERED]
        sizes = np.array(list(map(len, words)))
        ends, word = np.cumsum(sizes), np.repeat(np.arange(len(words)), sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        low, high, score, ids = self.trie.pieces(codes, np.repeat(ends, sizes))
        # Characters that are no piece are spelt in bytes; such an edge is numbered by its character.
        rare = np.flatnonzero(~self.trie.single[self.trie.number[codes]])
        spelt = self.byte_score * (1 + (codes[rare] >= 0x80) + (codes[rare] >= 0x800) + (codes[rare] >= 0x10000))
        low, high, score, ids = (np.concatenate(x) for x in ((low, rare), (high, rare + 1), (score, spelt), (ids, -2 - rare)))
        # A boundary is named by the character after it and its word, so words share none.
        low, high, first = low + word[low], high + word[low], ends - sizes + np.arange(len(words))
        order = np.lexsort((low, high))
        low, high, score, ids = low[order], high[order], score[order], ids[order]
        step = high - np.repeat(first, sizes + 1)[high]
        best, back, piece = np.full(len(codes) + len(words), -np.inf), np.zeros(len(codes) + len(words), int), np.zeros(len(codes) + len(words), int)
        best[first] = 0.0
        turns = np.argsort(step, kind="stable")
        for some in np.split(turns, np.flatnonzero(np.diff(step[turns])) + 1):
            ending, reach = high[some], best[low[some]] + score[some]
            edge = np.flatnonzero(np.append(True, ending[1:] != ending[:-1]))
            top = np.repeat(np.maximum.reduceat(reach, edge), np.diff(np.append(edge, len(some))))
            winner = np.flatnonzero(reach == top)  # of equal scores the earliest start wins; starts lie in order
            winner = winner[np.append(True, ending[winner][1:] != ending[winner][:-1])]
            best[ending[winner]], back[ending[winner]], piece[ending[winner]] = reach[winner], low[some][winner], ids[some][winner]
        at, path = first + sizes, []
        while (at > first).any():
            path.append(np.where(at > first, piece[at], -1))
            at = np.where(at > first, back[at], at)
        table = np.array(path[::-1]).T
        there = table != -1
        raw, edges = table[there].astype(np.int32).tobytes(), np.concatenate(([0], np.cumsum(there.sum(1)))) * 4
        for k, text in enumerate(words):
            self.known[text] = raw[edges[k]:edges[k + 1]]
        for k in np.flatnonzero((table < -1).any(1)).tolist():
            ids = [i for p in table[k][there[k]].tolist()
                   for i in ([p] if p >= 0 else [self.first_byte + c for c in self._raw(words[k][-2 - p - int(ends[k] - sizes[k])])])]
            self.known[words[k]] = np.array(ids, np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses; the text's own marks are parts of their own, as None."""
        out = []
        for i, run in enumerate(text.split(MARK)):
            marked = run.replace(" ", MARK) if i else MARK + run.replace(" ", MARK)
            out.extend([None] if i else [])
            out.extend(self.parts.findall(marked) if self.parts else [marked] if marked else [])
        return out

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        cuts = [self.cut(t) if t else [] for t in texts]
        if self.parts is not None:
            self.learn({p for cut in cuts for p in cut if p is not None})
        known, part = self.known.get, self._part
        return [np.frombuffer(b"".join([known(p) or (self.mark if p is None else part(p)) for p in cut]), np.int32) for cut in cuts]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "surrogatepass")[1:]

    def spells(self, ids: np.ndarray, text: str) -> bool:
        """Whether decoding gives the text back, byte for byte, without a string per id."""
        raw = (" " + text if text else "").encode("utf-8", "surrogatepass")
        size = self.length[ids]
        if size.sum() != len(raw):
            return False
        at = np.arange(len(raw)) + np.repeat(self.begin[ids] - (np.cumsum(size) - size), size)
        return self.letters[at].tobytes() == raw


def _encoded(vocabulary: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            step = 64
            for low in range(0, batch.num_rows, step):
                some = batch.slice(low, step)
                texts = some.column(some.num_columns - 1).to_pylist()
                found = encoder.encode_all(texts)
                same = [encoder.spells(ids, t) for ids, t in zip(found, texts)]
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found), pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(np.diff(offsets), pa.int32()), ids, pa.array(same)],
                                                 names=[*some.schema.names[:-1], "n_ids", "ids", "same"])
    return run


def encoded(docs: DataFrame, vocabulary: dict, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` of ``docs`` (all by default) with n_ids, ids, and whether decoding
    gives the text back. A null or empty text has no ids. Carried columns of these names give
    way. Pieces that a text can't be made of are spelt in bytes, so every text comes back."""
    carry = [c for c in (docs.columns if carry is None else carry) if c not in ("n_ids", "ids", "same")]
    kinds = dict(docs.dtypes)
    ready = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)], whole_text(F.col(text)).alias("text"))
    schema = ", ".join([*(f"c{i} {kinds[c]}" for i, c in enumerate(carry)), "n_ids int, ids array<int>, same boolean"])
    return ready.mapInArrow(_encoded(vocabulary), schema).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], "n_ids", "ids", "same")


def _decoded(pieces: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(map(pieces.__getitem__, ids.as_py() or [])).decode("utf-8", "surrogatepass")[1:]
                     for ids in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "text"])
    return run


def decoded(rows: DataFrame, vocabulary: dict, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) of rows of ids; null ids give an empty text."""
    kind = dict(rows.dtypes)[key]
    ready = rows.select(F.col(f"`{key}`").alias("c0"), F.col(ids).alias("ids"))
    return ready.mapInArrow(_decoded(vocabulary["bytes"]), f"c0 {kind}, text string").select(F.col("c0").alias(key), "text")
