"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, with the model's leading space, is a lattice: edges are pieces, weighted by their rank in the vocabulary
(``(rank + 10) ** -SHARPNESS``); a character without a piece is one edge of byte pieces. Forward filtering sums, per
position, the weights of all paths that reach it; backward sampling walks from the end and picks each edge by its share.
No piece reaches over the start of a space run, so words are filtered on their own, each distinct word of a block once.
A draw is a hash of the row's key and the place in the text, so a row's segmentation can be repeated anywhere. Decoding joins the pieces' bytes.

Edge cases: null and empty texts have no pieces and decode to the empty text; a literal U+2581 is encoded as bytes, so
it does not turn into a space; characters outside the vocabulary go by bytes; words of any length are filtered whole,
sums being rescaled; rows of equal key and text get equal pieces, a null key is a key of its own; empty tables give
empty results; further columns are carried unless they bear the name of an output.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import bounded_batches, table
from ferrule.llm.hashing import BASE, U64, power_tables, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 7
SHARPNESS = 1.0
#: Scale of the weights per character, which keeps sums in range.
PER_CHARACTER = 30.0
#: Weight of a character that goes by its bytes; it has no other edge.
BYTES_WEIGHT = 1e-2
#: Bits of a node's unit, which its edges share.
SHARE_BITS = 36
#: Characters and rows that a task works on at a time, and leading bits that index its table of pieces.
BLOCK = 1 << 18
#: Blocks over which a task notes words that come again, and how many of them it keeps filtered.
WARM_BLOCKS, KEPT_WORDS = 16, 1 << 16
ROWS = 512
#: Characters from which a word is filtered edge by edge: a pass over all words per position would cost more.
LONG_WORD = 2048
#: Words that are left at which sampling goes on one by one.
FEW = 8
MASK = (1 << 64) - 1
TOP_BITS = 17
SPACES = re.compile(r"[^ ] ")


class Lattice:
    """The vocabulary as a hash table of pieces and of their prefixes, and the sampler over blocks of texts."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = [b""] * sp.get_piece_size()
        self.byte_ids = np.zeros(256, np.int32)
        known: dict[str, tuple[int, float]] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain = piece.replace("\u2581", " ")
                if " " in plain.lstrip(" "):
                    continue  # it would reach over the start of a space run
                # paths through a word have equal lengths, so a factor per character changes no share
                known[plain] = (i, (10 + max(0.0, -sp.get_score(i))) ** -SHARPNESS * PER_CHARACTER ** len(plain))
                self.bytes[i] = plain.encode()
        self.longest = max(map(len, known))
        entries = {plain[:k] for plain in known for k in range(1, len(plain) + 1)}
        ids = np.array([known.get(e, (-1, 0.0))[0] for e in entries], np.int32)
        self.piece_weights = np.zeros(len(self.bytes))
        for ident, weight in known.values():
            self.piece_weights[ident] = weight
        points = [np.frombuffer(e.encode("utf-32-le"), np.uint32).astype(np.uint64) for e in entries]
        up, down = power_tables(64)
        totals = np.array([((p + U64(1)) * up[: len(p)]).sum(dtype=np.uint64) for p in points], np.uint64)
        hashes = mix(totals + np.array([len(p) for p in points], np.uint64))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], ids[order]
        self.noted: set[int] = set()
        self.common: dict[int, np.ndarray] = {}
        self.blocks, self.kept = 0, None
        # where the entries of each leading bit pattern start: a search then looks at a few entries only
        self.first = np.searchsorted(self.hashes, np.arange(1 << TOP_BITS, dtype=np.uint64) << U64(64 - TOP_BITS))
        self.probes = int(np.diff(np.append(self.first, len(self.hashes))).max())

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash in the table, -1 where it is missing."""
        at = self.first[(hashes >> U64(64 - TOP_BITS)).astype(np.int64)]
        found = np.full(len(hashes), -1, np.int64)
        left = np.arange(len(hashes))
        for _ in range(self.probes):
            spot = np.minimum(at, len(self.hashes) - 1)
            own = self.hashes[spot]
            hit = own == hashes[left]
            found[left[hit]] = spot[hit]
            go = ~hit & (own < hashes[left])
            left, at = left[go], at[go] + 1
            if not len(left):
                break
        return found

    def encode_block(self, texts: list[str], seeds: np.ndarray, bases: list[int]) -> list[np.ndarray]:
        """Pieces of each text, which starts with a space; ``bases``: its place in its row, which numbers the draws."""
        sizes = np.array([len(t) for t in texts])
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        n = len(chars)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        _, down = power_tables(n)
        sums = self._sums(chars)
        space = chars == 32
        opens = space.copy()
        opens[1:] &= ~space[:-1]
        opens[rows[:-1]] = True
        start = np.flatnonzero(opens)
        size = np.diff(np.append(start, n))
        names = mix((sums[start + size] - sums[start]) * down[start] + size.astype(np.uint64))
        named, sample, word = np.unique(names, return_index=True, return_inverse=True)
        seeds = np.array(seeds, np.uint64) + (np.array(bases, np.int64) - rows[:-1]).astype(np.uint64) * U64(BASE)
        shift = seeds[np.searchsorted(rows, start, side="right") - 1]
        picked, present = np.zeros(n, np.int32), np.zeros(n, bool)
        kept = np.full(len(named), -1)
        if self.kept is not None:
            spot = np.minimum(np.searchsorted(self.kept[0], named), len(self.kept[0]) - 1)
            kept = np.where(self.kept[0][spot] == named, spot, -1)
            own = np.flatnonzero(kept[word] >= 0)
            self._sample(self.kept[1], kept[word[own]], start[own], size[own], shift[own], picked, present)
        else:
            self._remember(named, start[sample], size[sample], chars)
        new = np.flatnonzero(kept < 0)
        if len(new):
            ends = self._filtered(sums, down, chars, start[sample[new]], size[sample[new]])
            number = np.full(len(named), -1)
            number[new] = np.arange(len(new))
            own = np.flatnonzero(number[word] >= 0)
            self._sample(ends, number[word[own]], start[own], size[own], shift[own], picked, present)
        return self._collected(rows, picked, present)

    def _remember(self, named, start, size, chars) -> None:
        """Over the first blocks, note words that come again; then keep their filtered lattices for all later blocks."""
        short = np.flatnonzero(size <= 64)
        again = [i for i in short.tolist() if int(named[i]) in self.noted]
        self.noted.update(named[short].tolist())
        for i in again:
            if len(self.common) < KEPT_WORDS:
                self.common[int(named[i])] = chars[start[i] : start[i] + size[i]].copy()
        self.blocks += 1
        if self.blocks < WARM_BLOCKS and len(self.common) < KEPT_WORDS or not self.common:
            return
        names = np.array(sorted(self.common), np.uint64)
        words = [self.common[int(k)] for k in names]
        text, size = np.concatenate(words), np.array([len(w) for w in words])
        _, down = power_tables(len(text))
        sums = self._sums(text)
        self.kept = (names, self._filtered(sums, down, text, np.cumsum(size) - size, size))
        self.noted, self.common = set(), {}

    @staticmethod
    def _sums(chars: np.ndarray) -> np.ndarray:
        up, _ = power_tables(len(chars))
        sums = np.zeros(len(chars) + 1, np.uint64)
        np.cumsum((chars.astype(np.uint64) + U64(1)) * up[: len(chars)], out=sums[1:])
        return sums

    def _filtered(self, sums, down, chars, start, size):
        """Forward filter of distinct words: per node its incoming edges and their shares."""
        node0 = np.concatenate([[0], np.cumsum(size + 1)])  # a node before each character and one behind the word
        flat = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        offset = flat - np.repeat(start, size)
        left = np.repeat(size, size) - offset
        node = np.repeat(node0[:-1], size) + offset
        here, parts = np.arange(len(flat)), []
        for length in range(1, self.longest + 1):
            here = here[left[here] >= length]
            if not len(here):
                break
            at = flat[here]
            found = self._find(mix((sums[at + length] - sums[at]) * down[at] + U64(length)))
            ids = np.where(found >= 0, self.ids[found], -1)
            if length == 1:  # a character without a piece: one edge of its bytes, told by a negative id
                whole, ids = here, np.where(ids >= 0, ids, -1 - chars[at].astype(np.int32))
            else:
                whole, ids = here[ids >= 0], ids[ids >= 0]
            parts.append((whole, ids, np.full(len(ids), length, np.int8)))
            here = here[found >= 0]
        place, ids, length = (np.concatenate(x) for x in zip(*parts, strict=True))
        depth = offset[place] + length
        end = node[place] + length
        order = np.argsort(depth.astype(np.int16) if depth.max() < 1 << 15 else depth, kind="stable")
        end, length, ids, depth = end[order], length[order], ids[order], depth[order]
        begin, share = end - length, np.where(ids >= 0, self.piece_weights[np.maximum(ids, 0)], BYTES_WEIGHT)
        total = np.zeros(node0[-1])
        total[node0[:-1]] = 1.0
        word = np.repeat(np.arange(len(size)), size)[place[order]]
        long = size[word] > LONG_WORD
        for w in np.unique(word[long]):
            own = np.flatnonzero(word == w)
            share[own] = self._summed(begin[own] - node0[w], end[own] - node0[w], share[own], int(size[w]))
        short = np.flatnonzero(~long) if long.any() else slice(None)
        share[short] = self._summed_at_once(begin[short], end[short], share[short], depth[short], total, node0, size)
        share /= np.bincount(end, share, minlength=len(total))[end]  # a node's edges are all on one scale
        # by node, then by length, without a sort: every node has a slot per length
        slots = np.zeros(len(total) * self.longest, np.int32)
        slots[end * self.longest + (length - 1)] = np.arange(1, len(end) + 1, dtype=np.int32)
        order = slots[slots > 0] - 1
        degree = np.bincount(end, minlength=len(total))
        rank = np.cumsum(degree > 0) - 1  # nodes with edges, counted: each takes one unit of the running sum
        first = np.concatenate([[0], np.cumsum(degree)])
        # whole numbers: a draw's outcome must not depend on what else is in the block, as rounded sums would
        parts = (share[order] * (1 << SHARE_BITS)).astype(np.int64)
        last = first[np.flatnonzero(degree) + 1] - 1
        parts[last] += (1 << SHARE_BITS) - np.diff(np.cumsum(parts)[last], prepend=0)
        return node0, rank, first, np.cumsum(parts), length[order].astype(np.int64), ids[order]

    def _summed(self, begin, end, share, size: int) -> list[float]:
        """Edge weights times the sum of all paths to their start, of one long word, edge by edge."""
        total, out, done = [1.0] + [0.0] * size, share.tolist(), 0
        for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
            if b != done:
                if done and done % self.longest == 0:  # rescale what later positions still read
                    scale = total[done]
                    for i in range(done - self.longest + 1, done + 1):
                        total[i] /= scale
                done = b
            out[k] *= total[a]
            total[b] += out[k]
        return out

    def _summed_at_once(self, begin, end, share, depth, total, node0, size) -> np.ndarray:
        """The same for all words that are not long, position by position."""
        if not len(depth):
            return share
        cuts = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        for at, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True), 1):
            share[lo:hi] *= total[begin[lo:hi]]
            np.add.at(total, end[lo:hi], share[lo:hi])
            if at % self.longest == 0:  # rescale, word by word, what later positions still read
                last = node0[:-1][(size >= at) & (size <= LONG_WORD)] + at
                scale = total[last]
                for back in range(self.longest):
                    total[last - back] /= scale
        return share

    @staticmethod
    def _sample(ends, word, start, size, shift, picked, present) -> None:
        """Backward sampling of all words at once, a step being one piece of each word not yet through."""
        node0, rank, first, running, length, ids = ends
        order = np.argsort(word, kind="stable")  # neighbours in the lattice are then neighbours in memory
        at, node, shift = (start + size)[order], (node0[word] + size)[order], shift[order]
        done = node0[word][order]
        while len(at):
            if len(at) <= FEW:  # the rest of very long words, one by one
                for spot in zip(at.tolist(), node.tolist(), done.tolist(), shift.tolist(), strict=True):
                    _walk(ends, *spot, picked, present)
                return
            draw = (mix(shift + at.astype(np.uint64) * U64(BASE)) >> U64(64 - SHARE_BITS)).astype(np.int64)
            edge = np.searchsorted(running, (rank[node] << SHARE_BITS) + draw, side="right")
            edge = np.clip(edge, first[node], first[node + 1] - 1)
            picked[at - 1], present[at - 1] = ids[edge], True
            at, node = at - length[edge], node - length[edge]
            go = node > done
            at, node, done, shift = at[go], node[go], done[go], shift[go]

    def _collected(self, rows, picked, present) -> list[np.ndarray]:
        """The pieces of each text in order, characters without a piece by their bytes."""
        spot = np.flatnonzero(present)
        out, per_row = picked[spot], np.searchsorted(spot, rows)
        if len(lone := np.flatnonzero(out < 0)):
            raw = np.frombuffer("".join(map(chr, -1 - out[lone])).encode(), np.uint8)
            count = np.ones(len(out), np.int64)
            point = -1 - out[lone]
            count[lone] = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
            by_bytes = np.repeat(out < 0, count)
            out = np.repeat(out, count)
            out[by_bytes] = self.byte_ids[raw]
            per_row = np.concatenate([[0], np.cumsum(count)])[per_row]
        out = out.astype(np.int32)
        return [out[a:b] for a, b in zip(per_row[:-1], per_row[1:], strict=True)]

    def encode(self, texts: list[str | None], keys: list, seed: int = SEED) -> list[np.ndarray]:
        """A sampled segmentation of each whole text; equal (text, key, seed) give equal pieces."""
        seeds = np.array([_row_seed(k, seed) for k in keys], np.uint64)
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        block: list[tuple[int, str, int]] = []
        held = 0

        def flush() -> None:
            nonlocal held
            if block:
                made = self.encode_block([t for _, t, _ in block], seeds[[r for r, _, _ in block]], [b for _, _, b in block])
                for (r, _, _), ids in zip(block, made, strict=True):
                    parts[r].append(ids)
            block.clear()
            held = 0

        for r, text in enumerate(texts):
            text, at = (" " + text if text else ""), 0
            while at < len(text):
                cut = len(text)
                if cut - at > BLOCK:  # long texts go on at the start of a space run
                    m = SPACES.search(text, at + BLOCK)
                    cut = m.end() - 1 if m else cut
                block.append((r, text[at:cut], at))
                held += cut - at
                at = cut
                if held >= BLOCK:
                    flush()
        flush()
        return [np.concatenate(p) if p else np.empty(0, np.int32) for p in parts]

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes.__getitem__, ids))[1:].decode("utf-8", "replace") if len(ids) else ""


def _walk(ends, at: int, node: int, done: int, shift: int, picked, present) -> None:
    """Backward sampling of one word; the same draws as for all words at once."""
    _, rank, first, running, length, ids = ends
    while node > done:
        x = (shift + at * BASE) & MASK
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
        x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
        draw = (x ^ x >> 31) >> (64 - SHARE_BITS)
        lo, hi = int(first[node]), int(first[node + 1])
        wanted = (int(rank[node]) << SHARE_BITS) + draw
        edge = lo
        while edge < hi - 1 and running[edge] <= wanted:
            edge += 1
        picked[at - 1], present[at - 1] = ids[edge], True
        step = int(length[edge])
        at, node = at - step, node - step


def _row_seed(key: object, seed: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{seed}:{key}".encode(), digest_size=8).digest(), "big")


_lattices: dict[str, Lattice] = {}


def lattice(model: str) -> Lattice:
    """One per model and Python worker; the vocabulary's size bounds it."""
    if model not in _lattices:
        _lattices[model] = Lattice(model)
    return _lattices[model]


def _encoded(batch: pa.RecordBatch, own: Lattice, seed: int, id_col: str, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], pa.ListArray]]:
    """Parts of a batch with their pieces, which take more room than the texts."""
    for lo in range(0, len(batch), ROWS):
        part = batch.slice(lo, ROWS)
        ids = own.encode(part.column(text_col).to_pylist(), part.column(id_col).to_pylist(), seed)
        yield part, ids, pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), np.concatenate(ids))


def encode_pieces(docs: DataFrame, model: str = MODEL, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``piece_ids``, sampled per row."""
    bounded_batches(docs.sparkSession)
    rest = docs.drop("piece_ids")
    schema = T.StructType([*rest.schema, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            for part, _, pieces in _encoded(batch, own, seed, id_col, text_col):
                yield pa.RecordBatch.from_arrays([*part.columns, pieces], [*part.schema.names, "piece_ids"])

    return rest.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model: str = MODEL, ids_col: str = "piece_ids") -> DataFrame:
    """``encoded`` with ``decoded``, the text of its pieces."""
    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def decode(ids: pd.Series) -> pd.Series:
        own = lattice(model)
        return pd.Series([own.decode(i) if i is not None else "" for i in ids], dtype=object)

    return encoded.withColumn("decoded", decode(ids_col))


def round_trip(
    docs: DataFrame, model: str = MODEL, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", names: tuple[str, str] = ("piece_ids", "decoded")
) -> DataFrame:
    """``docs`` with the pieces of its texts and the text that decoding these pieces gives, in one pass and one worker."""
    bounded_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema, T.StructField(names[0], T.ArrayType(T.IntegerType())), T.StructField(names[1], T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattice(model)
        for batch in batches:
            for part, ids, pieces in _encoded(batch, own, seed, id_col, text_col):
                decoded = pa.array((own.decode(i) for i in ids), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, pieces, decoded], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = round_trip(docs)
    return both.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.hash("piece_ids").alias("pieces_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )
