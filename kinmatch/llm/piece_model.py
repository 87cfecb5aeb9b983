"""A SentencePiece model's vocabulary as a byte trie in numpy, and the lattices of many strings at once."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece

from kinmatch.llm import textkernel as tk

_MARK = "▁"
#: What a normaliser would change, and what it must be for the lattice to see the same text as the library.
_PROBE = " a  \tB\u00c5A\u030a\uff21\ufb01 "
_PROBE_NORMALISED = (" " + _PROBE).replace(" ", _MARK)


@dataclass
class Lattice:
    """Edges of all strings, grouped by the place where they begin; place i of data is node i."""

    begin: np.ndarray  # edges of node i: begin[i]:stop[i]
    stop: np.ndarray
    total: np.ndarray  # log of the summed weight of all paths from the node to its string's end
    to: np.ndarray
    piece: np.ndarray  # -n: a character's n bytes
    share: np.ndarray  # cumulative share of the paths from the node on, by edge
    weight: np.ndarray  # of pieces, and of -1 to -4 at its end

    def score(self, edges: np.ndarray | list[int] | int) -> np.ndarray:
        """The log weight of each edge."""
        return self.weight[self.piece[edges]]


class PieceModel:
    """Pieces with log weights. White space marks are spaces inside; a text begins with one.

    A unigram model's scores are its log probabilities. A BPE model has ranks instead: piece weights then follow
    Zipf's law, 1 / (rank + 2.7), normalised over the vocabulary.
    """

    def __init__(self, proto: bytes, theta: float = 1.0) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        score = np.array([sp.get_score(i) for i in range(n)])
        self.byte_id = np.full(256, -1, dtype=np.int32)
        usable = []
        self.text: list[bytes] = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                self.byte_id[int(name[3:5], 16)] = i
                self.text.append(bytes([int(name[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.text.append(b"")
            else:
                usable.append(i)
                self.text.append(name.replace(_MARK, " ").encode())
        if (self.byte_id < 0).any():
            raise ValueError("the model needs byte pieces")
        if sp.normalize(_PROBE) != _PROBE_NORMALISED:
            raise ValueError("the model changes texts before it segments them")
        size = np.array([len(t) for t in self.text])
        self.size, self.start = size, np.cumsum(size) - size
        self.bytes = np.frombuffer(b"".join(self.text), dtype=np.uint8)
        use = np.array(usable)
        if (score[use] <= 0).all() and np.array_equal(np.round(score[use]), score[use]):  # ranks
            rank = np.minimum(-score[use], len(use))
            weight = -np.log(rank + 2.7)
        else:
            weight = score[use]
        weight = theta * (weight - np.log(np.exp(weight).sum()))
        self.unknown = float(weight.min() - 10 * theta)  # as unigram models do, per character
        # trie: (state, byte) -> state, and the piece that ends in a state
        nodes: dict[tuple[int, int], int] = {}
        ends: dict[int, int] = {}
        for i in usable:
            at = 0
            for b in self.text[i]:
                at = nodes.setdefault((at, b), len(nodes) + 1)
            ends[at] = i
        self.end = np.full(len(nodes) + 1, -1, dtype=np.int32)
        self.end[list(ends)] = list(ends.values())
        self.weight = np.full(n + 4, self.unknown)  # the last four: a character of so many bytes
        self.weight[:n] = -np.inf
        self.weight[use] = weight
        keys = np.array([s * 256 + b for s, b in nodes], dtype=np.uint64)
        values = np.array(list(nodes.values()), dtype=np.int32)
        bits = max(10, int(len(keys) * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.full(1 << bits, (1 << 64) - 1, dtype=np.uint64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)
        slot = (tk.mix(keys) & self.mask).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            _, once = np.unique(slot[left], return_index=True)
            put = left[once][self.keys[slot[left[once]]] == self.keys.dtype.type((1 << 64) - 1)]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & int(self.mask)
        # strings fall apart where no piece can stand: before a space after something else, and around bytes of no longer piece
        joined = np.zeros(256, dtype=bool)
        space_inside = False
        for i in usable:
            t = self.text[i]
            if len(t.decode()) > 1:
                joined[list(t)] = True
            space_inside |= b" " in t.lstrip(b" ")
        self.alone = ~joined & (np.arange(256) < 128)
        self.cut_at_space = not space_inside

    def normalised(self, texts: pa.Array) -> pa.Array:
        """Texts as the lattice sees them: a space before a text that isn't empty, and marks as spaces."""
        texts = pc.replace_substring(texts.fill_null(""), _MARK, " ")
        return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))

    def strings(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the strings begin that texts fall apart into."""
        n = len(data)
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        if n > 1:
            if self.cut_at_space:
                cut[1:n] |= (data[1:] == 0x20) & (data[:-1] != 0x20)
            alone = self.alone[data]
            cut[1:n] |= alone[1:] | alone[:-1]
        return np.flatnonzero(cut[:n])

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The trie's state after a byte, or -1."""
        key = (state.astype(np.uint64) << np.uint64(8)) | byte.astype(np.uint64)
        slot = (tk.mix(key) & self.mask).astype(np.int64)
        out = np.full(len(key), -1, dtype=np.int32)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot[left]]
            hit = found == key[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != np.uint64((1 << 64) - 1))]
            slot[left] = (slot[left] + 1) & int(self.mask)
        return out

    def lattice(self, data: np.ndarray, starts: np.ndarray) -> Lattice:
        """The lattice of every string data[starts[i]:starts[i + 1]]."""
        n = len(data)
        if not n:
            none = np.zeros(0, dtype=np.int32)
            return Lattice(none, none, none.astype(float), none, none, none.astype(float), self.weight)
        lead = (data & 0xC0) != 0x80
        at = np.flatnonzero(lead).astype(np.int32 if n < 1 << 31 else np.int64)
        ends = np.append(starts[1:], n)
        end_of = np.repeat(ends, ends - starts)
        width = np.diff(np.append(at, n))
        state = np.zeros(len(at), dtype=np.int32)
        here = at.copy()
        own, stop = at, end_of[at]
        alone = np.zeros(n, dtype=bool)
        width_at = np.zeros(n, dtype=np.int64)
        width_at[at] = width
        src, dst, piece, rank = [], [], [], []
        edges = np.zeros(n, dtype=np.int32)  # of each node so far
        while len(own):
            state = self._next(state, data[here])
            go = state >= 0
            own, here, state, stop = own[go], here[go] + 1, state[go], stop[go]
            hit = self.end[state] >= 0
            a, b = own[hit], here[hit]
            src.append(a)
            dst.append(b)
            piece.append(self.end[state[hit]])
            rank.append(edges[a])
            edges[a] += 1
            alone[a[b - a == width_at[a]]] = True
            more = here < stop
            own, here, state, stop = own[more], here[more], state[more], stop[more]
        bare = at[~alone[at]]
        src.append(bare)
        dst.append(bare + width_at[bare])
        piece.append(-width_at[bare])
        rank.append(edges[bare])
        edges[bare] += 1
        # nodes in order of their distance from their string's end, so that sums over paths go over slices of edges
        far = (end_of - np.arange(n))[at]
        turn = np.argsort(far.astype(np.uint16) if far.max() < 1 << 16 else far, kind="stable")
        nodes, far = at[turn], far[turn]
        count = edges[nodes].astype(np.int64)
        first = np.cumsum(count) - count
        begin = np.zeros(n, dtype=np.int32)
        stop = np.zeros(n, dtype=np.int32)
        begin[nodes], stop[nodes] = first, first + count
        to, piece_of = np.empty(count.sum(), np.int32), np.empty(count.sum(), np.int32)
        for a, b, c, r in zip(src, dst, piece, rank, strict=True):
            place = begin[a] + r
            to[place], piece_of[place] = b, c
        del src, dst, piece, rank
        value_of = self.weight[piece_of]
        total = np.zeros(n + 1)
        after = np.where(to == np.repeat(end_of[nodes], count), to.dtype.type(n), to)  # nothing follows an edge that ends its string
        share = np.empty(len(to))
        level = np.append(np.flatnonzero(np.diff(far, prepend=-1)), len(nodes))
        for lo, hi in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
            a, b = first[lo], first[hi - 1] + count[hi - 1]
            cut, own = first[lo:hi] - a, count[lo:hi]
            value = value_of[a:b] + total[after[a:b]]
            most = np.maximum.reduceat(value, cut)
            value -= np.repeat(most, own)
            np.exp(value, out=value)
            added = np.add.reduceat(value, cut)
            total[nodes[lo:hi]] = most + np.log(added)
            value /= np.repeat(added, own)
            np.cumsum(value, out=value)
            value -= np.repeat(np.concatenate([[0.0], value[cut[1:] - 1]]), own)
            share[a:b] = value
        share[first + count - 1] = 1.0  # whatever rounding leaves
        return Lattice(begin, stop, total[:n], to, piece_of, share, self.weight)

    def ids(self, lattice: Lattice, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path of edges over data (a piece's id, or the ids of a character's bytes), and where each edge's ids begin."""
        piece = lattice.piece[edges]
        bare = piece < 0
        if not bare.any():
            return piece, np.arange(len(edges) + 1)
        size = np.where(bare, -piece, 1)
        begin = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(piece, size)
        at = np.flatnonzero(out < 0)
        edge = np.repeat(np.flatnonzero(bare), size[bare])
        out[at] = self.byte_id[data[lattice.to[edges[edge]] - size[edge] + at - begin[edge]]]
        return out, begin

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the space that every text begins with; bytes that are no UTF-8 become U+FFFD."""
        return self.decode_all(ids, np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """``decode`` of each ids[bounds[i]:bounds[i + 1]]."""
        size = self.size[ids]
        end = np.concatenate([[0], np.cumsum(size)])
        raw = self.bytes[np.repeat(self.start[ids] - end[:-1], size) + np.arange(end[-1])].tobytes()
        cut = end[bounds].tolist()
        return [raw[a:b].decode("utf-8", "replace").removeprefix(" ") for a, b in zip(cut[:-1], cut[1:], strict=True)]


class LatticeStore:
    """The lattices of the distinct strings met so far, one behind the other in growing arrays; a worker builds each once.

    When it holds more than ``most`` bytes of strings (about 60 bytes of memory for each), only those stay that were met
    most often, so its memory is bounded by that and one chunk. New strings' lattices are built from about
    ``slice_bytes`` at a time. What it holds changes the time, never a result.
    """

    def __init__(self, model: PieceModel, most: int = 3 << 19, slice_bytes: int = 1 << 17) -> None:
        self.model, self.most, self.slice_bytes = model, most, slice_bytes
        self.known: dict[bytes, int] = {}  # strings in order of their first nodes
        self.base, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of each string: first node, chunks that held it
        self.nodes = self.edges = 0
        self.data = np.zeros(0, np.uint8)
        few, none = np.zeros(0, np.int32), np.zeros(0)
        self.lattice = Lattice(few, few, none, few, few, none, model.weight)

    def places(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The first node of each string raw[starts[i]:ends[i]], all different; those not yet here are added."""
        strings = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        if self.nodes > self.most:
            self._purge()
        known = self.known
        number = np.fromiter(map(known.get, strings, repeat(-1)), np.int64, len(strings))
        new = np.flatnonzero(number < 0)
        self.met[number[number >= 0]] += 1
        first = len(known)
        number[new] = np.arange(first, first + len(new))
        self.base = _grown(self.base, first, np.zeros(len(new), np.int64))
        self.met = _grown(self.met, first, np.ones(len(new), np.int64))
        held = np.concatenate([[0], np.cumsum((ends - starts)[new])])
        lo = 0
        while lo < len(new):
            hi = max(lo + 1, int(np.searchsorted(held, held[lo] + self.slice_bytes, side="right")) - 1)
            part = [strings[i] for i in new[lo:hi].tolist()]
            known.update(zip(part, range(first + lo, first + hi), strict=True))
            base = held[lo:hi] - held[lo]
            self.base[first + lo : first + hi] = base + self.nodes
            own = np.frombuffer(b"".join(part), dtype=np.uint8)
            self._append(own, self.model.lattice(own, base))
            lo = hi
        return self.base[number]

    def _append(self, data: np.ndarray, more: Lattice) -> None:
        nodes, edges, at = self.nodes, self.edges, self.lattice
        self.data = _grown(self.data, nodes, data)
        at.begin, at.stop = _grown(at.begin, nodes, more.begin + np.int32(edges)), _grown(at.stop, nodes, more.stop + np.int32(edges))
        at.total = _grown(at.total, nodes, more.total)
        at.to = _grown(at.to, edges, more.to + np.int32(nodes))
        at.piece, at.share = _grown(at.piece, edges, more.piece), _grown(at.share, edges, more.share)
        self.nodes, self.edges = nodes + len(data), edges + len(more.to)

    def _purge(self) -> None:
        """Keep the strings met most often, so many that they take at most half of the room."""
        n, at = len(self.known), self.lattice
        size = np.diff(np.append(self.base[:n], self.nodes))
        least = 2
        while size[self.met[:n] >= least].sum() > self.most // 2:
            least *= 2
        stay = self.met[:n] >= least
        base = np.cumsum(np.where(stay, size, 0)) - np.where(stay, size, 0)
        shift = np.repeat(base - self.base[:n], size)  # of each node
        node = np.flatnonzero(np.repeat(stay, size))
        count = (at.stop[node] - at.begin[node]).astype(np.int64)
        begin = np.cumsum(count) - count
        edge = np.repeat(at.begin[node] - begin, count) + np.arange(count.sum())
        self.data = self.data[node]
        to = (at.to[edge] + np.repeat(shift[node], count)).astype(np.int32)
        self.lattice = Lattice(begin.astype(np.int32), (begin + count).astype(np.int32), at.total[node], to, at.piece[edge], at.share[edge], at.weight)
        self.nodes, self.edges = len(node), len(edge)
        self.known = {x: i for i, x in enumerate(x for x, here in zip(self.known, stay.tolist(), strict=True) if here)}
        self.base, self.met = base[stay], np.ones(len(self.known), np.int64)


def _grown(have: np.ndarray, n: int, more: np.ndarray) -> np.ndarray:
    """The first n of have, then more, with room for a quarter more where it had to move."""
    if n + len(more) > len(have):
        room = np.empty(n + len(more) + (n + len(more)) // 4, dtype=have.dtype)
        room[:n] = have[:n]
        have = room
    have[n : n + len(more)] = more
    return have
