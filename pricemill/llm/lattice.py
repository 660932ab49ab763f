"""Lattices of vocabulary pieces over many words at once.

A word is a run of bytes that no piece crosses. Its lattice has a node before every byte and an edge
for every piece that matches, or for a single byte of a character without a piece of its own. All words of a batch are
built together: pieces are found by rolling hashes, and the forward sums run level by level in log
space, so words of any length are safe.
"""

from __future__ import annotations

import numpy as np

from .bytework import BASE_A, Rolling, mixed

# Place of the model file; a parameter wherever it is used.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
# The mark of a word's start in piece files, and the byte that stands for it here.
WORD_MARK, SPACE = "▁", b" "
# The file orders pieces by rank. Zipf's law with this shift turns a rank into a probability.
ZIPF_SHIFT = 2.7


class Pieces:
    """Vocabulary with log probabilities and a hash table of its pieces' bytes; small enough to send to every task."""

    def __init__(self, texts: list[bytes], logp: np.ndarray, byte_ids: np.ndarray, end_id: int):
        self.texts, self.logp, self.byte_ids, self.end_id = texts, logp, byte_ids, end_id
        self._built = None

    def __getstate__(self):
        return {**self.__dict__, "_built": None}

    def with_logp(self, logp: np.ndarray) -> "Pieces":
        return Pieces(self.texts, logp, self.byte_ids, self.end_id)

    def index(self):
        """(lengths, hash by piece, tables): a piece is in the first table whose slot it got."""
        if self._built is None:
            roll = Rolling(BASE_A)
            use = [i for i, t in enumerate(self.texts) if t]
            flat = np.frombuffer(b"".join(self.texts[i] for i in use), np.uint8).astype(np.uint64) + np.uint64(1)
            size = np.array([len(self.texts[i]) for i in use])
            end = np.cumsum(size)
            key = np.zeros(len(self.texts), np.uint64)
            key[use] = roll.runs(roll.prefix(flat), end - size, end)
            tables, rest = [], np.array(use, np.int64)
            for shift in (44, 24, 4):
                table = np.full(1 << 20, -1, np.int32)
                slot = ((key[rest] >> np.uint64(shift)) & np.uint64(0xFFFFF)).astype(np.int64)
                table[slot[::-1]] = rest[::-1]
                tables.append((np.uint64(shift), table))
                rest = rest[table[slot] != rest]
            if len(rest):
                raise ValueError("two pieces share a hash")
            self._built = sorted(set(size.tolist())), key, [t for t in tables if (t[1] >= 0).any()]
        return self._built

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id by hash; -1 where there is none."""
        _, key, tables = self.index()
        out = np.full(len(h), -1, np.int32)
        for shift, table in tables:
            got = table[((h >> shift) & np.uint64(0xFFFFF)).astype(np.int64)]
            hit = np.flatnonzero(got >= 0)
            hit = hit[key[got[hit]] == h[hit]]
            out[hit] = got[hit]
        return out


def load(path: str = MODEL_FILE) -> Pieces:
    """Read a piece file on the driver. Pieces that hold the word mark after their first place cross words and are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    texts, rank, byte_ids = [b""] * n, np.full(n, -1.0), np.zeros(256, np.int32)
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and WORD_MARK not in piece[1:]:
            texts[i], rank[i] = piece.replace(WORD_MARK, " ").encode(), -model.get_score(i)
    weight = np.where(rank >= 0, 1 / (rank + ZIPF_SHIFT), 0.0)
    weight[byte_ids] = 1 / (n + ZIPF_SHIFT)  # bytes carry no rank: they come last
    with np.errstate(divide="ignore"):
        return Pieces(texts, np.log(weight / weight.sum()), byte_ids, model.eos_id())


class Lattice:
    """Lattices of the words ``data[offsets[i]:offsets[i + 1]]``, none of them empty."""

    def __init__(self, pieces: Pieces, data: np.ndarray, offsets: np.ndarray):
        self.pieces, self.n = pieces, len(offsets) - 1
        size = np.diff(offsets)
        word = np.repeat(np.arange(self.n), size)
        left = np.repeat(offsets[1:], size) - np.arange(len(data))  # bytes up to the word's end
        roll = Rolling(BASE_A)
        prefix = roll.prefix(data.astype(np.uint64) + np.uint64(1))
        at = np.arange(len(data))
        heads, ids, lengths = [], [], []
        single = np.zeros(len(data) + 1, bool)  # bytes of characters that are pieces
        lead = (data & 0xC0) != 0x80
        char = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
        for length in pieces.index()[0]:
            at = at[left[at] >= length]
            if not len(at):
                break
            starts = at[lead[at]]
            got = pieces.find(roll.runs(prefix, starts, starts + length))
            hit = got >= 0
            heads.append(starts[hit])
            ids.append(got[hit])
            lengths.append(np.full(int(hit.sum()), length, np.int32))
            alone = starts[hit & (char[starts] == length)]
            for k in range(length if length <= 4 else 0):
                single[alone + k] = True
        loose = np.flatnonzero(~single[:-1])
        heads.append(loose)
        ids.append(pieces.byte_ids[data[loose]])
        lengths.append(np.ones(len(loose), np.int32))
        del prefix, at, left, single, lead, char
        head, self.id, length = np.concatenate(heads), np.concatenate(ids), np.concatenate(lengths)
        del heads, ids, lengths
        depth = (head - offsets[word[head]] + length).astype(np.int32)
        end = (head + word[head] + length).astype(np.int32)
        del head, word
        order = np.argsort(depth * np.int64(len(data) + self.n + 1) + end, kind="stable")
        self.id, self.end, depth = self.id[order], end[order], depth[order]
        self.start = self.end - length[order]
        del end, order, length
        self.first, self.last = offsets[:-1] + np.arange(self.n), offsets[1:] + np.arange(self.n)
        group = np.flatnonzero(np.diff(self.end, prepend=-1))  # edges of one end node are neighbours
        self.group, self.bound = group, np.append(group, len(self.end))
        self.levels = np.searchsorted(depth[group], np.arange(1, int(depth[-1]) + 2 if len(depth) else 1))
        self.nodes = len(data) + self.n
        self._forward()

    def _forward(self) -> None:
        """Log of the summed weights of all ways to each node."""
        self.alpha = np.zeros(self.nodes)
        weight = self.pieces.logp[self.id]
        for a, b in zip(self.levels[:-1], self.levels[1:]):
            if a == b:
                continue
            lo, hi = self.bound[a], self.bound[b]
            way = self.alpha[self.start[lo:hi]] + weight[lo:hi]
            at = self.group[a:b] - lo
            top = np.maximum.reduceat(way, at)
            size = np.diff(np.append(at, hi - lo))
            self.alpha[self.end[self.group[a:b]]] = top + np.log(np.add.reduceat(np.exp(way - np.repeat(top, size)), at))

    def log_marginals(self) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        return self.alpha[self.last]

    def expected(self, times: np.ndarray) -> np.ndarray:
        """Expected uses of every piece when word i occurs ``times[i]`` times."""
        share = np.zeros(self.nodes)
        share[self.last] = times
        out = np.zeros(len(self.pieces.logp))
        weight = self.pieces.logp[self.id]
        for a, b in zip(self.levels[-2::-1], self.levels[:0:-1]):
            if a == b:
                continue
            lo, hi = self.bound[a], self.bound[b]
            flow = share[self.end[lo:hi]] * np.exp(self.alpha[self.start[lo:hi]] + weight[lo:hi] - self.alpha[self.end[lo:hi]])
            share += np.bincount(self.start[lo:hi], flow, self.nodes) if hi - lo > self.nodes // 8 else self._scatter(self.start[lo:hi], flow)
            out += np.bincount(self.id[lo:hi], flow, len(out))
        return out

    def _scatter(self, at: np.ndarray, value: np.ndarray):
        out = np.zeros(self.nodes)
        np.add.at(out, at, value)
        return out

    def choices(self) -> None:
        """Shares of the edges into each node: the likeliest by itself, the others cumulated so that one search picks one."""
        share = np.exp(self.alpha[self.start] + self.pieces.logp[self.id] - self.alpha[self.end])
        size, n = np.diff(self.bound), len(self.group)
        of = np.repeat(np.arange(n), size)
        self.top_share = np.maximum.reduceat(share, self.group)
        best = np.flatnonzero(share >= self.top_share[of])
        self.top = np.zeros(n, np.int64)
        self.top[of[best[::-1]]] = best[::-1]
        share[self.top] = 0.0
        run = np.cumsum(share)
        self.ladder = np.minimum(run - np.repeat(run[self.group] - share[self.group], size), 1.0) + of
        self.place = np.zeros(self.nodes, np.int32)
        self.place[self.end[self.group]] = np.arange(n, dtype=np.int32)

    def sample(self, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One segmentation of ``word[i]`` drawn with key[i]: all piece ids, and how many each took."""
        self.choices()
        node, who = self.last[word], np.arange(len(word))
        taken = np.zeros(len(word), np.int64)
        steps = []
        step = 0
        while len(who):
            u = (mixed(key[who] + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0 ** -53
            spot = self.place[node]
            edge = self.top[spot]
            rest = np.flatnonzero(u >= self.top_share[spot])
            at = spot[rest]
            edge[rest] = np.clip(np.searchsorted(self.ladder, at + (u[rest] - self.top_share[at]), "right"), self.bound[at], self.bound[at + 1] - 1)
            steps.append((who, self.id[edge]))
            taken[who] += 1
            node = self.start[edge]
            go = node != self.first[word[who]]
            who, node = who[go], node[go]
            step += 1
        last = np.cumsum(taken) - 1
        out = np.empty(int(taken.sum()), np.int32)
        for k, (w, i) in enumerate(steps):
            out[last[w] - k] = i
        return out, taken
