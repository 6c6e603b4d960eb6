"""Alignment of two tokenizers over the same bytes, by products of sparse incidence matrices.

A token covers bytes of its text, so each tokenizer has a token-byte incidence matrix, with one
row per token. The texts of a block lie one behind the other, so a block has one matrix pair ``A``
and ``B`` and no entry joins two texts. The matrices are in compressed rows, and their products
are taken row by row: row i of a product adds up the rows of the right factor that the entries
of row i name. ``A B^T`` has an entry for each two tokens that share bytes: the links. Where tokens
of both end at one byte a group of tokens ends; the product of the token-group matrices, ``G H^T``,
has an entry for each two tokens of one group.

Blocks are cut while texts are encoded, every few megabytes of text, wherever the rows lie, so no key
can make one block large; a text is never split. A block gives its distinct id pairs with their numbers
of links, Spark adds those up over the corpus, and each block gets back what it asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from prismatica.llm.common import ship, whole_text

ship(sys.modules[__name__])

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of the byte-level vocabulary, as its family of encoders cuts them (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space that is too long for the ranked encoder's expressions.
LONG_BLANK = 50_000
#: Products of matrix entries that are expanded in one go.
EXPANDED = 1 << 19


# --- matrices in compressed rows ------------------------------------------------------

@dataclass
class Csr:
    """Row i has the entries ``starts[i]`` to ``starts[i + 1]`` of ``columns`` and ``values``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int

    def transposed(self) -> Csr:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.columns, kind="stable")
        return Csr(_starts(np.bincount(self.columns, minlength=self.width)), rows[order], self.values[order], len(self.starts) - 1)


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def runs(sizes: np.ndarray) -> Csr:
    """Row i has ones in the ``sizes[i]`` columns that follow those of the rows before."""
    starts = _starts(sizes)
    return Csr(starts, np.arange(starts[-1]), np.ones(starts[-1], np.int32), int(starts[-1]))


def memberships(columns: np.ndarray, width: int) -> Csr:
    """Row i has a one in column ``columns[i]``."""
    return Csr(np.arange(len(columns) + 1), columns, np.ones(len(columns), np.int32), width)


def row_products(a: Csr, b: Csr, expanded: int = EXPANDED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The entries (row, column, value) of ``a b`` in order, some rows at a time: for each entry (i, k)
    of ``a`` row k of ``b`` is fetched, and equal columns of a row are added up. At most ``expanded``
    fetched entries are held, but for a row that has more of its own."""
    length = np.diff(b.starts)
    low, height = 0, len(a.starts) - 1
    while low < height:
        high = max(low + 1, int(np.searchsorted(a.starts, a.starts[low] + expanded, "right")) - 1)
        entries = a.columns[a.starts[low]:a.starts[high]]
        until = np.cumsum(length[entries])
        if len(until) and until[-1] > expanded and high > low + 1:  # rows of b are long: fewer rows of a
            last = a.starts[low] + int(np.searchsorted(until, expanded, "right"))
            high = max(low + 1, int(np.searchsorted(a.starts, last, "right")) - 1)
            entries, until = entries[:a.starts[high] - a.starts[low]], until[:a.starts[high] - a.starts[low]]
        times = length[entries]
        row = np.repeat(np.arange(low, high), np.diff(a.starts[low:high + 1]))
        if len(times) and times.min() == times.max() == 1:
            at, value = b.starts[entries], a.values[a.starts[low]:a.starts[high]]
        else:
            at = np.arange(times.sum()) + np.repeat(b.starts[entries] - (until - times), times)
            row, value = np.repeat(row, times), np.repeat(a.values[a.starts[low]:a.starts[high]], times)
        column, value = b.columns[at], value * b.values[at]
        new_row, step = np.diff(row) > 0, np.diff(column)
        if (~new_row & (step < 0)).any():
            order = np.lexsort((column, row))
            row, column, value = row[order], column[order], value[order]
            new_row, step = np.diff(row) > 0, np.diff(column)
        if len(row):
            edge = np.concatenate(([0], np.flatnonzero(new_row | (step != 0)) + 1))
            yield row[edge], column[edge], np.add.reduceat(value, edge)
        low = high


# --- tokenizers -----------------------------------------------------------------------

@dataclass
class Vocabulary:
    """A tokenizer file and the bytes of each id; both are of the size of the vocabulary."""

    kind: str
    model: bytes
    tokens: list[bytes]
    #: How many ids are no special tokens; those come first.
    plain: int

    @property
    def lengths(self) -> np.ndarray:
        return np.array(list(map(len, self.tokens)), np.int64)

    @property
    def dtype(self):
        return np.uint16 if len(self.tokens) <= 1 << 16 else np.uint32


def byte_letters() -> dict[str, int]:
    """Letter to byte of byte-level vocabularies: printable Latin-1 stands for itself, the other
    bytes, in order, for the letters from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def load_byte_bpe(path: str = BYTE_BPE) -> Vocabulary:
    with open(path, "rb") as file:
        model = file.read()
    said, letters = json.loads(model), byte_letters()
    special = {t["id"]: t["content"].encode() for t in said.get("added_tokens", [])}
    ids = {i: bytes(map(letters.__getitem__, token)) for token, i in said["model"]["vocab"].items() if i not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in said["model"]["merges"]]
    if sorted(ids) != list(range(len(ids))) or any(said["model"]["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        raise ValueError(f"{path}: merges are not numbered in order")
    every = ids | special
    return Vocabulary("byte", model, [every[i] for i in range(len(every))], len(ids))


def load_pieces(path: str = PIECES) -> Vocabulary:
    import sentencepiece
    with open(path, "rb") as file:
        model = file.read()
    read = sentencepiece.SentencePieceProcessor(model_proto=model)
    tokens = [bytes([int(read.id_to_piece(i)[3:5], 16)]) if read.is_byte(i) else read.id_to_piece(i).replace(MARK, " ").encode()
              for i in range(read.get_piece_size())]
    return Vocabulary("piece", model, tokens, len(tokens))


class Pieces:
    """Ids of a piece vocabulary, whose encoder adds the space itself."""

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece
        self.vocabulary, self.model = vocabulary, sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)

    def encode(self, text: str) -> np.ndarray | None:
        ids = self.model.encode(text)
        same = b"".join(map(self.vocabulary.tokens.__getitem__, ids)) == (" " + text).encode("utf-8", "surrogatepass")
        return np.array(ids, self.vocabulary.dtype) if same else None


class Bytes:
    """Ids of a byte-level vocabulary. Its merges are numbered in order, so the ranked encoder gives the ids
    of the file's own, at several times the speed; it cannot split very long white space, the other can."""

    def __init__(self, vocabulary: Vocabulary):
        import tiktoken
        self.vocabulary, self.lengths, self.slow = vocabulary, vocabulary.lengths, None
        self.ranked = tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks={t: i for i, t in enumerate(vocabulary.tokens[:vocabulary.plain])},
                                        special_tokens={})

    def encode(self, text: str) -> np.ndarray | None:
        text = " " + text
        if len(text) >= LONG_BLANK and re.search(rf"\s{{{LONG_BLANK}}}", text):
            if self.slow is None:
                import os
                os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_buffer(self.vocabulary.model)
                self.slow.encode_special_tokens = True
            ids = np.array(self.slow.encode(text, add_special_tokens=False).ids, self.vocabulary.dtype)
        else:
            ids = self.ranked.encode_to_numpy(text, disallowed_special=()).astype(self.vocabulary.dtype)
        # Every byte has an id of its own, so the ids spell the text.
        return ids if self.lengths[ids].sum() == len(text.encode("utf-8", "surrogatepass")) else None


def encoder(vocabulary: Vocabulary) -> Pieces | Bytes:
    """Texts to ids of a space and the text, without special tokens; None if their bytes differ from those."""
    return Pieces(vocabulary) if vocabulary.kind == "piece" else Bytes(vocabulary)


# --- blocks ---------------------------------------------------------------------------

def _encoded(a: Vocabulary, b: Vocabulary, share: int):
    """Blocks: keys, numbers of tokens, packed ids by ``a`` and by ``b``, distinct id pairs and their links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        pack, encoders, task = zstandard.ZstdCompressor(level=1), (encoder(a), encoder(b)), TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        keys, ids, held = [], ([], []), 0

        def out() -> pa.RecordBatch:
            block = Block.over([np.array(list(map(len, side)), np.int64) for side in ids], [np.concatenate(side) for side in ids], a, b)
            found = [np.unique(x * len(b.tokens) + y, return_counts=True) for _, x, y in block.pairs()]
            pairs, place = np.unique(np.concatenate([p for p, _ in found] or [np.empty(0, np.int64)]), return_inverse=True)
            n = np.bincount(place, np.concatenate([c for _, c in found] or [np.empty(0)]), len(pairs)).astype(np.int64)
            every = pa.concat_arrays(keys)
            whole = pa.array([0, len(every)], pa.int32())
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.ListArray.from_arrays(whole, every), *[pa.ListArray.from_arrays(whole, pa.array(s)) for s in block.sizes],
                 *[pa.array([pack.compress(x)]) for x in (*[np.concatenate(side).tobytes() for side in ids], pairs.tobytes(), n.tobytes())]],
                names=["block", "keys", "sizes_a", "sizes_b", "ids_a", "ids_b", "pairs", "links"])

        for batch in batches:
            low = 0
            while low < batch.num_rows:
                some = batch.slice(low, 16)
                for text in some.column(1).to_pylist():
                    got = [e.encode(text) if text else None for e in encoders]
                    for side, x, v in zip(ids, got, (a, b)):
                        side.append(np.empty(0, v.dtype) if any(g is None for g in got) else x)
                    held += len(text)
                keys.append(some.column(0))
                low += 16
                if held >= share:
                    yield out()
                    keys, ids, held, number = [], ([], []), 0, number + 1
        if keys:
            yield out()
    return run


@dataclass
class Block:
    """Tokens of the texts of a block, and the two products."""

    sizes: list[np.ndarray]
    ids: list[np.ndarray]
    lengths: list[np.ndarray]

    @classmethod
    def over(cls, sizes: list[np.ndarray], ids: list[np.ndarray], a: Vocabulary, b: Vocabulary) -> Block:
        ids = [x.astype(np.int64) for x in ids]
        return cls(sizes, ids, [a.lengths[ids[0]], b.lengths[ids[1]]])

    @classmethod
    def of(cls, row: dict, a: Vocabulary, b: Vocabulary) -> Block:
        return cls.over([np.array(row["sizes_a"], np.int64), np.array(row["sizes_b"], np.int64)],
                        [_unpacked(row[name], v.dtype) for name, v in (("ids_a", a), ("ids_b", b))], a, b)

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, common bytes) of all tokens that overlap: the entries of ``A B^T``."""
        n = len(self.lengths[1])
        return row_products(runs(self.lengths[0]), memberships(np.repeat(np.arange(n), self.lengths[1]), n))

    def group_columns(self) -> tuple[np.ndarray, np.ndarray, int]:
        """The group of each token of A and of B, and how many groups there are."""
        ends = [np.cumsum(n) for n in self.lengths]
        common = np.intersect1d(*ends, assume_unique=True)
        return np.searchsorted(common, ends[0]), np.searchsorted(common, ends[1]), len(common)

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(token of A, token of B, 1) of all tokens that share a group: the entries of ``G H^T``."""
        of_a, of_b, n = self.group_columns()
        return row_products(memberships(of_a, n), memberships(of_b, n).transposed())

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(text, id of A, id of B) of each link."""
        text = np.repeat(np.arange(len(self.sizes[0])), self.sizes[0])
        for x, y, _ in self.links():
            yield text[x], self.ids[0][x], self.ids[1][y]


def _asked(table: pa.Table) -> pa.Table:
    """The distinct id pairs of a block with their numbers of links, a row each."""
    found = [(n, _unpacked(p, np.int64), _unpacked(c, np.int64)) for n, p, c in zip(*(table.column(k).to_pylist() for k in ("block", "pairs", "links")))]
    return pa.table({"block": pa.array(np.concatenate([np.full(len(p), n) for n, p, _ in found])), "pair": pa.array(np.concatenate([p for _, p, _ in found])),
                     "n": pa.array(np.concatenate([c for _, _, c in found]))})


def _unpacked(raw: bytes, kind) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


def _group_text(block: Block, words: list[bytes], width: int) -> Iterator[str]:
    """sha256 of ``a1,a2|b1;a3|b2,b3`` of each text, '' of a text without tokens. ``words`` holds each id with a
    comma, then each with the end of its side of a group, ``width`` of them a time, of A and then of B."""
    of_a, of_b, n = block.group_columns()
    in_a, in_b = np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n)
    codes = np.empty(len(of_a) + len(of_b), np.int64)
    for side, (ids, group, sizes, shift) in enumerate(((block.ids[0], of_a, in_a, _starts(in_b)[:-1]), (block.ids[1], of_b, in_b, _starts(in_a)[1:]))):
        code = ids + 2 * side * width
        code[np.cumsum(sizes) - 1] += width
        codes[np.arange(len(ids)) + shift[group]] = code
    ends = np.cumsum(block.sizes[0] + block.sizes[1])
    for low, high in zip(np.concatenate(([0], ends)), ends):
        yield hashlib.sha256(b"".join(map(words.__getitem__, codes[low:high].tolist()))[:-1]).hexdigest() if high > low else ""


class Totals:
    """Where the pairs of a block are told: by id of B, the most frequent id of A first, so that nearly all
    are found in the first place or two."""

    def __init__(self, x: np.ndarray, y: np.ndarray, total: np.ndarray, width: int):
        self.order = np.lexsort((-total, y))
        self.x, self.total = x[self.order], total[self.order]
        self.first = np.searchsorted(y[self.order], np.arange(width))

    def places(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at, left = self.first[y], np.arange(len(x))
        while len(left):
            left = left[self.x[at[left]] != x[left]]
            at[left] += 1
        return at


def _scored(a: Vocabulary, b: Vocabulary):
    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        known = Totals(*np.divmod(told.column("pair").to_numpy(), len(b.tokens)), told.column("total").to_numpy(), len(b.tokens))
        total, best = known.total, told.column("best").to_numpy(zero_copy_only=False).astype(np.int64)[known.order]
        width = max(len(a.tokens), len(b.tokens))
        words = [str(i).encode() + end for end in (b",", b"|", b",", b";") for i in range(width)]
        out = []
        for row, keys in zip(table.to_pylist(), table.column("keys").combine_chunks()):
            block = Block.of(row, a, b)
            n_texts = len(block.sizes[0])
            counts = {name: np.zeros(n_texts, np.int64) for name in ("n_groups", "n_links", "n_group_links", "n_best", "count_sum")}
            for text, x, y in block.pairs():
                at = known.places(x, y)
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                counts["n_links"][text[first]] += np.diff(np.append(first, len(text)))
                counts["n_best"][text[first]] += np.add.reduceat(best[at], first)
                counts["count_sum"][text[first]] += np.add.reduceat(total[at], first)
            of_a, of_b, n = block.group_columns()
            in_b = np.bincount(of_b, minlength=n)
            text = np.repeat(np.arange(n_texts), block.sizes[0])
            if len(text):
                first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
                counts["n_group_links"][text[first]] = np.add.reduceat(in_b[of_a], first)
                ends = np.cumsum(block.sizes[0])[text[first]] - 1
                counts["n_groups"][text[first]] = np.diff(np.concatenate(([0], of_a[ends] + 1)))
            out.append(pa.table([keys.values, *[pa.array(s) for s in block.sizes], *[pa.array(c) for c in counts.values()],
                                 pa.array(list(_group_text(block, words, width)), pa.string())],
                                names=["key", "n_a", "n_b", *counts, "groups_sha256"]))
        return pa.concat_tables(out)
    return run


def aligned_tokens(docs: DataFrame, a: Vocabulary, b: Vocabulary, key: str = "doc_id", text: str = "text", share_mb: int = 4) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_group_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    ``a`` encodes a space and the text, ``b`` the text, to which it adds a space. A text that is null or
    empty, or that the ids of either do not give back byte for byte, has no tokens and zeros. n_links counts
    pairs of tokens that overlap, n_group_links pairs in one group. The count of an id pair is its number of
    links in the whole table; count_sum adds it up over the links of a text, n_best counts those links whose
    pair has the highest count of its id of ``b``, ties included. groups_sha256 is the digest of all groups
    written ``a1,a2|b1;a3|b2,b3``, or '' without tokens. Null and repeated keys are rows like others; extra
    columns are not read; an empty table gives an empty one.
    """
    kind, width = dict(docs.dtypes)[key], len(b.tokens)
    rows = docs.select(F.col(f"`{key}`").alias("key"), whole_text(F.col(f"`{text}`")).alias("text"))
    blocks = rows.mapInArrow(_encoded(a, b, share_mb << 20), f"block long, keys array<{kind}>, sizes_a array<long>, sizes_b array<long>, "
                                                             "ids_a binary, ids_b binary, pairs binary, links binary").groupBy("block")
    asked = blocks.applyInArrow(_asked, "block long not null, pair long not null, n long not null")
    totals = asked.groupBy("pair").agg(F.sum("n").alias("total")).withColumn("b", F.col("pair") % width)
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    told = asked.select("block", "pair").join(known, "pair").select("block", "pair", "total", "best")
    scored = blocks.cogroup(told.groupBy("block")).applyInArrow(
        _scored(a, b), f"key {kind}, n_a long, n_b long, n_groups long, n_links long, n_group_links long, n_best long, count_sum long, "
                       "groups_sha256 string")
    return scored.select(F.col("key").alias(key), *[c for c in scored.columns if c != "key"])
