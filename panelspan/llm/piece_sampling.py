"""SentencePiece encoding by forward filtering and backward sampling, and lossless decoding.

A text, with one space put before it, is cut into runs of spaces with the characters
that follow, and runs of over SEGMENT characters are cut there too; no piece crosses
such a cut, so the piece lattice of a text is the product of the small lattices of its
segments, and a text of any length is sampled a bounded number of segments at a time. Forward filtering gives each lattice node the
total weight of the paths to it; backward sampling then walks from the end, picking
each incoming piece with its share of that weight. A chunk's new segments build their
lattices together, and all its segments walk back together, in numpy; lattices of
earlier chunks are kept up to KEEP nodes, since words repeat.

The uniform numbers come from a hash of the row key, the segment's place in the row and
the step, so a row's segmentation depends on neither partitions nor batches.

Characters without a piece of their own become byte pieces; so does a literal U+2581,
which stands for a space inside pieces. Decoding therefore gives back the text exactly.

Defined results: a null text has null ids, no pieces, and counts as lossless; an empty
text has none; rows with equal keys and texts get equal ids; a null key is one seed;
the kept columns may have any names but the three that are added.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspan.llm import textops as T
from panelspan.llm.common import broadcast_value

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Sharpness of the piece weights rank ** -ALPHA; larger comes closer to the best segmentation.
ALPHA = 1.5
SEED = 17
#: Bytes of text whose lattices are built together.
CHUNK = 1 << 18
#: Lattice nodes that are kept for later chunks (some 30 MB); beyond them a new set is begun.
KEEP = 1 << 19
#: Characters of the longest segment, spaces and others apart.
SEGMENT = 1024
_SPACE = "▁"
#: Stands for a literal U+2581 in a text; no piece has it.
_LITERAL = 0x110000


def read_vocabulary(path: str = MODEL) -> list[tuple[str, str, float]]:
    """(piece, kind, score) by id; kind is normal, byte or other."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: "byte" if sp.is_byte(i) else "other" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "normal"
    return [(sp.id_to_piece(i), kind(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


def _char_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums from which _run_hashes takes the hash of any run of characters."""
    pow_, inv = T._powers(len(codes))
    sums = np.zeros(len(codes) + 1, T.U64)
    np.cumsum(T.mix(codes.astype(T.U64) + T.U64(1)) * pow_[: len(codes)], out=sums[1:])
    return sums, inv


def _run_hashes(sums: np.ndarray, inv: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return T.mix((sums[at + n] - sums[at]) * inv[at] + T.U64(n * 0xA0761D6478BD642F % (1 << 64)))


class Pieces:
    """A vocabulary as lookup arrays: built once on the driver, then broadcast."""

    def __init__(self, vocabulary: list[tuple[str, str, float]], alpha: float = ALPHA):
        order = sorted((i for i, (_, k, _) in enumerate(vocabulary) if k == "normal"), key=lambda i: -vocabulary[i][2])
        order = [i for i in order if _SPACE not in vocabulary[i][0].lstrip(_SPACE)]
        weight = -alpha * np.log(np.arange(len(order)) + 2.0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k, _) in enumerate(vocabulary) if k == "byte"}
        self.byte_weight = -alpha * np.log(len(vocabulary) + 2.0)
        run = f"{{1,{SEGMENT}}}"
        plain = f" {{0,{SEGMENT}}}[^ ]{run}| {run}"
        self.pattern = plain if any("\n" in vocabulary[i][0] for i in order) else plain.replace("[^ ]", "[^ \n]") + "|\n"
        self.size = len(vocabulary)
        raw = [p.replace(_SPACE, " ").encode() if k == "normal" else bytes([int(p[3:5], 16)]) if k == "byte" else b"" for p, k, _ in vocabulary]
        self.piece_len = np.array([len(r) for r in raw], np.int64)
        self.piece_first = np.concatenate([[0], np.cumsum(self.piece_len)])[:-1]
        self.piece_bytes = np.frombuffer(b"".join(raw), np.uint8)
        # every prefix of a piece, by hash, with the piece that it is or -1: runs that are no prefix are given up early
        size = np.array([len(vocabulary[i][0]) for i in order], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        sums, inv = _char_hashes(np.frombuffer("".join(vocabulary[i][0] for i in order).encode("utf-32-le"), np.uint32))
        self.longest = int(size.max(initial=1))
        keys, pieces, weights = [], [], []
        for n in range(1, self.longest + 1):
            some = np.flatnonzero(size >= n)
            whole = size[some] == n
            keys.append(_run_hashes(sums, inv, begin[some], n))
            pieces.append(np.where(whole, np.array(order, np.int64)[some], -1))
            weights.append(np.where(whole, weight[some], 0.0))
        key, piece, weight = np.concatenate(keys), np.concatenate(pieces), np.concatenate(weights)
        by = np.lexsort((-piece, key))
        key, piece, weight = key[by], piece[by], weight[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.keys, self.key_piece, self.key_weight = key[new], piece[new], weight[new]


class Grown:
    """An array that is appended to in place; its first n entries count."""

    def __init__(self, kind):
        self.held, self.n = np.empty(1 << 16, kind), 0

    def add(self, values: np.ndarray) -> None:
        need = self.n + len(values)
        if need > len(self.held):
            held = np.empty(max(need, len(self.held) * 3 // 2), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : need] = values
        self.n = need

    def now(self) -> np.ndarray:
        return self.held[: self.n]


class Lattices:
    """Piece lattices of segments, in flat arrays: node n's incoming arcs are those whose cdf lies in (n, n + 1]."""

    def __init__(self, pieces: Pieces):
        self.__dict__.update(pieces.__dict__)
        self.pattern = re.compile(pieces.pattern)
        self.char_arcs: dict[int, int] = {}
        self.arc_ids: list[list[int]] = []
        self.maybe = np.zeros(1 << 21, bool)
        self.maybe[(self.keys >> T.U64(43)).astype(np.int64)] = True
        self.forget()

    def forget(self) -> None:
        """Begin a new set of lattices."""
        self.known: dict[str, int] = {}
        self.nodes = 0
        self._cdf, self._prev, self._arc, self._starts, self._ends = (Grown(k) for k in (np.float64, np.int32, np.int32, np.int64, np.int64))

    def _byte_arcs(self, codes: np.ndarray) -> np.ndarray:
        """Arcs, beyond the pieces, that spell characters in bytes."""
        for c in np.unique(codes):
            if int(c) not in self.char_arcs:
                self.char_arcs[int(c)] = self.size + len(self.arc_ids)
                self.arc_ids.append([self.byte_ids[b] for b in (_SPACE if c == _LITERAL else chr(c)).encode()])
        keys = np.array(sorted(self.char_arcs), np.int64)
        return np.array([self.char_arcs[int(k)] for k in keys], np.int64)[np.searchsorted(keys, codes)]

    def build(self, segments: list[str]) -> None:
        """The lattices of distinct segments, all at once, added to those there are."""
        codes = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), np.int32).copy()
        codes[codes == ord(_SPACE)] = _LITERAL
        codes[codes == 0x20] = ord(_SPACE)
        size = np.fromiter(map(len, segments), np.int64, len(segments))
        stop = np.cumsum(size).astype(np.int32)  # places fit 32 bits: chunks are bounded, but for one longer text
        number = np.repeat(np.arange(len(segments), dtype=np.int32), size)
        limit = stop[number]
        sums, inv = _char_hashes(codes)
        at = np.arange(len(codes), dtype=np.int32)
        ends, starts, arcs, weights = [], [], [], []
        for n in range(1, self.longest + 1):
            at = at[at + n <= limit[at]]
            if not len(at):
                break
            h = _run_hashes(sums, inv, at, n)
            some = self.maybe[(h >> T.U64(43)).astype(np.int64)]
            kept, h = at[some], h[some]
            key = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            there = self.keys[key] == h
            kept, key = kept[there], key[there]
            piece = self.key_piece[key]
            whole = piece >= 0
            if n == 1:
                bare = np.ones(len(codes), bool)
                bare[kept[whole]] = False
                lone = np.flatnonzero(bare).astype(np.int32)
                if len(lone):
                    arc = self._byte_arcs(codes[lone])
                    many = np.array([len(a) for a in self.arc_ids])[arc - self.size]
                    ends.append(lone + 1)
                    starts.append(lone)
                    arcs.append(arc.astype(np.int32))
                    weights.append((self.byte_weight * many).astype(np.float32))
            ends.append(kept[whole] + n)
            starts.append(kept[whole])
            arcs.append(piece[whole].astype(np.int32))
            weights.append(self.key_weight[key[whole]].astype(np.float32))
            at = kept
        # node numbers: character places, with one more node before each segment
        start, end = np.concatenate(starts), np.concatenate(ends)
        seg = number[start]
        order = np.argsort(end + seg, kind="stable")
        start, end, seg = start[order], end[order], seg[order]
        arc, weight = np.concatenate(arcs)[order], np.concatenate(weights)[order]
        base = (stop - size + np.arange(len(segments))).astype(np.int64)
        node, prev = end + seg, start + seg
        depth = end - (stop - size)[seg]
        by = np.argsort(depth.astype(np.uint16) if depth.max(initial=0) < 65536 else depth, kind="stable")
        bounds = np.searchsorted(depth[by], np.arange(1, depth.max(initial=0) + 2))
        total = np.zeros(len(codes) + len(segments) + 1)
        share = np.empty(len(arc))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            who = by[lo:hi]
            to = node[who]
            first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            way = total[prev[who]] + weight[who]
            top = np.maximum.reduceat(way, first)
            many = np.diff(np.append(first, len(who)))
            part = np.exp(way - np.repeat(top, many))
            whole = np.add.reduceat(part, first)
            total[to[first]] = top + np.log(whole)
            run = np.cumsum(part / np.repeat(whole, many))
            run -= np.repeat(np.concatenate([[0.0], run[first[1:] - 1]]), many)
            run[np.append(first[1:], len(who)) - 1] = 1.0
            share[who] = run
        self._cdf.add(node + share + self.nodes)
        self._prev.add(prev + self.nodes)
        self._arc.add(arc)
        self._starts.add(base + self.nodes)
        self._ends.add(base + size + self.nodes)
        self.nodes += len(codes) + len(segments)

    def segments(self, found: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(segment number of each occurrence, first occurrence of each text) of the texts' segments, with their lattices built."""
        if self.nodes > KEEP:
            self.forget()
        known = self.known
        before = len(known)
        at = [known.setdefault(s, len(known)) for f in found for s in f]
        if len(known) > before:
            self.build(list(itertools.islice(known, before, None)))
        self.cdf, self.prev, self.arc, self.starts, self.ends = (g.now() for g in (self._cdf, self._prev, self._arc, self._starts, self._ends))
        return np.array(at, np.int64), np.concatenate([[0], np.cumsum([len(f) for f in found])])

    def runs(self, text: str, most: int) -> Iterator[list[str]]:
        """A text's segments, some at a time: as many as have about most characters."""
        held, size = [], 0
        for m in self.pattern.finditer(" " + text):
            held.append(m[0])
            size += len(m[0])
            if size >= most:
                yield held
                held, size = [], 0
        if held:
            yield held

    def sample(self, seg: np.ndarray, first: np.ndarray, seeds: np.ndarray, before: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first id of each text) of one segmentation of each text; before: how many segments of the text came earlier."""
        size = np.diff(first)
        place = before + np.arange(len(seg)) - np.repeat(first[:-1], size)
        key = T.mix(np.repeat(seeds, size) + place.astype(T.U64) * T.U64(0x9E3779B97F4A7C15))
        if not len(seg):
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        ends, starts = self.ends[seg], self.starts[seg]
        active, node, steps = np.arange(len(seg)), ends, []
        count = np.zeros(len(seg), np.int64)
        goal = starts
        step = 0
        while len(active):
            u = (T.mix(key[active] + T.U64(step)) >> T.U64(11)).astype(np.float64) * 2.0**-53
            e = np.searchsorted(self.cdf, node + np.minimum(u, 1 - 1e-9), "right")
            steps.append((active, self.arc[e]))
            count[active] += 1
            node = self.prev[e]
            more = node > goal
            active, node, goal = active[more], node[more], goal[more]
            step += 1
        at = np.concatenate([[0], np.cumsum(count)])
        arcs = np.empty(at[-1], np.int64)
        for k, (who, arc) in enumerate(steps):
            arcs[at[who + 1] - 1 - k] = arc
        bounds = at[first]
        many = arcs >= self.size
        if not many.any():
            return arcs.astype(np.int32), bounds
        lens = np.array([len(a) for a in self.arc_ids], np.int64)
        flat = np.concatenate([np.array(a, np.int64) for a in self.arc_ids])
        begin = np.concatenate([[0], np.cumsum(lens)])
        width = np.ones(len(arcs), np.int64)
        width[many] = lens[arcs[many] - self.size]
        out_at = np.concatenate([[0], np.cumsum(width)])
        ids = np.repeat(arcs, width)
        inner = np.arange(len(ids)) - np.repeat(out_at[:-1], width)
        wide = ids >= self.size
        ids[wide] = flat[begin[ids[wide] - self.size] + inner[wide]]
        return ids.astype(np.int32), out_at[bounds]

    def decode(self, ids: np.ndarray, first: np.ndarray, lead: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts that the ids spell, without the space put before each; lead 0: none was."""
        width = self.piece_len[ids]
        at = np.concatenate([[0], np.cumsum(width)])
        spot = np.arange(at[-1]) + np.repeat(self.piece_first[ids] - at[:-1], width)
        raw = self.piece_bytes[spot]
        off = at[first]
        if not lead:
            return raw, off
        keep = np.ones(len(raw), bool)
        keep[off[:-1][np.diff(off) > 0]] = False
        return raw[keep], np.concatenate([[0], np.cumsum(np.maximum(0, np.diff(off) - 1))])

    def encode_long(self, text: str, raw: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, bool]:
        """(ids, whether they spell the bytes raw) of one text, some segments at a time."""
        parts, same, before, at = [], True, 0, 0
        for held in self.runs(text, CHUNK):
            seg, first = self.segments([held])
            ids, _ = self.sample(seg, first, seed, before)
            back, _ = self.decode(ids, np.array([0, len(ids)]), int(before == 0))
            same = same and np.array_equal(back, raw[at : at + len(back)])
            parts.append(ids)
            before += len(held)
            at += len(back)
        return np.concatenate(parts), same and at == len(raw)


def _encode(batches: Iterator[pa.RecordBatch], shared, seed: int) -> Iterator[pa.RecordBatch]:
    lat = Lattices(shared.value)
    for batch in batches:
        column = batch.column("text")
        buf, offsets = T.string_buffer(column)
        seeds = T.mix(batch.column("row_seed").to_numpy().view(T.U64) + T.U64(seed))
        absent = column.is_null().to_numpy(zero_copy_only=False)
        for i, j, b, o in T.chunks(buf, offsets, CHUNK):
            if len(b) > 2 * CHUNK:  # one long text
                ids, whole = lat.encode_long(column[i].as_py(), b, seeds[i:j])
                first, same = np.array([0, len(ids)]), np.array([whole])
            else:
                ids, first = lat.sample(*lat.segments([lat.pattern.findall(" " + t) if t else [] for t in column.slice(i, j - i).to_pylist()]), seeds[i:j])
                back, off = lat.decode(ids, first)
                if np.array_equal(off, o) and np.array_equal(back, b):
                    same = np.ones(j - i, bool)
                else:
                    same = np.array([np.array_equal(back[off[k] : off[k + 1]], b[o[k] : o[k + 1]]) for k in range(j - i)], bool)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids), mask=pa.array(absent[i:j]))
            names = [c for c in batch.schema.names if c not in ("text", "row_seed")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in names), lists, pa.array(np.diff(first)), pa.array(same)], names=[*names, "ids", "n_pieces", "lossless"])


def _decode(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    lat = Lattices(shared.value)
    for batch in batches:
        col = batch.column("ids")
        values = col.flatten().to_numpy(zero_copy_only=False)
        size = np.array([n or 0 for n in col.value_lengths().to_pylist()], np.int64)
        raw, off = lat.decode(values, np.concatenate([[0], np.cumsum(size)]))
        data = raw.tobytes()
        texts = [None if v is None else data[off[k] : off[k + 1]].decode("utf-8", "replace") for k, v in enumerate(col.value_lengths().to_pylist())]
        names = [c for c in batch.schema.names if c != "ids"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "text"])


def _fields(df: DataFrame, keep: tuple[str, ...]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema)


def vocabulary(spark: SparkSession, model: str = MODEL, alpha: float = ALPHA):
    """The model's pieces, broadcast: tables of a vocabulary of fixed size, read on the driver alone."""
    return broadcast_value(spark, Pieces(read_vocabulary(model), alpha))


def encode(docs: DataFrame, shared, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """The kept columns with ids (one sampled segmentation), n_pieces, and lossless: decoding was compared with the text."""
    rows = docs.select(*keep, "text", F.xxhash64(F.col(key)).alias("row_seed"))
    return rows.mapInArrow(lambda it: _encode(it, shared, seed), f"{_fields(docs, keep)}, ids array<int>, n_pieces long, lossless boolean")


def decode(encoded: DataFrame, shared, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with the text that ids spell."""
    return encoded.select(*keep, "ids").mapInArrow(lambda it: _decode(it, shared), f"{_fields(encoded, keep)}, text string")
