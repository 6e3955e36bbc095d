"""Byte-level BPE over whole arrays: pre-token boundaries, token tables and merges in numpy, exactly as the library does it.

Pre-tokens are found from the class of each code point (letter, number, white space, other) in one pass over the bytes of
many texts at once; the pieces are looked up by hash in a table of pieces already encoded; only new pieces are merged, all of
them together. A hash only says where to look: every piece found is compared with the table's bytes, and pieces whose hash
another one has taken are kept by their bytes.
"""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np

from ._common import HashIndex, ranges

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 0
_MUL, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
#: Pieces longer than this are merged one by one with a heap, as merging all at once takes a pass per merge.
LONG = 40
#: A worker forgets its table of pieces (but for those entered for good) beyond so many pieces or bytes, so its memory is bounded.
MOST_PIECES, MOST_BYTES = 250_000, 32 << 20
_POWERS: dict[str, np.ndarray] = {}
_HEADS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _sure_cuts() -> np.ndarray:
    table = np.zeros((256, 256), bool)
    table[0x21:0x7F, [0x20, 0x0A, 0x09, 0x0D]] = True
    word, mark = [c for c in range(0x80) if chr(c).isalnum()], list(b".,;:!?\"()")
    table[np.ix_(word, mark)] = table[np.ix_(mark, word)] = True
    return table


_CUT = _sure_cuts()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], extra = chr(0x100 + extra), extra + 1
    return out


@functools.lru_cache(maxsize=4)
def class_table(path: str) -> bytes:
    """The class of every code point as the tokenizer's own splitter sees it, found once on the driver (1.1 MB).

    The classes are guessed with the regex module and put to the splitter block by block; where it cuts inside a block, the
    Unicode versions differ, and the block is halved down to single code points.
    """
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_file(path).pre_tokenizer
    leads = ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"))
    whole = lambda lead, text: len(split.pre_tokenize_str(lead + text)) == 1
    table = np.full(0x110000, OTHER, np.uint8)
    for plane in (0, 1, 2, 3, 14):
        text = "".join(chr(c) for c in range(plane << 16, (plane + 1) << 16) if not 0xD800 <= c < 0xE000)
        guess = {k: "".join(regex.findall(p, text)) for k, p in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (OTHER, r"[^\s\p{L}\p{N}]+"), (SPACE, r"\s+"))}
        todo = [(k, t[i : i + 4096]) for k, t in guess.items() for i in range(0, len(t), 4096)]
        while todo:
            kind, part = todo.pop()
            if kind != SPACE and whole(dict(leads)[kind], part):
                table[[ord(c) for c in part]] = kind
            elif len(part) > 1:
                todo += [(kind, part[: len(part) // 2]), (kind, part[len(part) // 2 :])]
            else:
                table[ord(part)] = next((k for k, lead in leads if whole(lead, part)), SPACE)
    return table.tobytes()


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        m = max(n, 1 << 18)
        for name, base in (("p", _MUL), ("i", _INV)):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each pair, from prefix sums of a polynomial modulo 2**64; never 0."""
    p, inv = _powers(len(data) + 1)
    acc = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
    h = (acc[ends] - acc[starts]) * inv[starts]
    h ^= (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return np.maximum(h, np.uint64(1))


class ByteLevelBPE:
    """spec: the tokenizer's JSON file; classes: class_table() of it. cuts: split pieces at forced boundaries."""

    def __init__(self, spec: bytes, classes: bytes, cuts: bool = True):
        doc = json.loads(spec)
        model = doc["model"]
        if doc.get("normalizer") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE files are supported")
        if doc["pre_tokenizer"]["type"] != "ByteLevel" or doc["pre_tokenizer"]["add_prefix_space"] or not doc["pre_tokenizer"]["use_regex"]:
            raise ValueError("only the usual byte-level splitter is supported")
        symbols = byte_symbols()
        back = {s: b for b, s in enumerate(symbols)}
        vocab = model["vocab"]
        self.special = {x["content"].encode(): x["id"] for x in doc["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        if size >= 1 << 16:
            raise ValueError("vocabularies of up to 65,535 entries are supported")
        self.bytes_of: list[bytes] = [b""] * size
        for word, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in word)
        self.vocab_ids = np.array(sorted(vocab.values()))
        for word, i in self.special.items():
            self.bytes_of[i] = word
        self.base = np.array([vocab[s] for s in symbols], np.int64)
        pairs, made = [], []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs.append((vocab[a] << 16 | vocab[b]) + 1)
            made.append(vocab[a + b])
        self.pairs = HashIndex(18)
        self.pairs.add(np.array(pairs, np.uint64))
        self.made = np.array(made, np.int64)
        self.rank = {k: r for r, k in enumerate(pairs)}
        self.classes = np.frombuffer(classes, np.uint8)
        self.cuts = None
        if cuts:  # pairs of neighbouring bytes inside some vocabulary string; no merge can span any other pair
            inside = np.zeros((256, 256), bool)
            words = [self.bytes_of[i] for i in self.vocab_ids]
            w = np.frombuffer(b"".join(words), np.uint8)
            within = np.ones(len(w), bool)
            within[np.cumsum([len(x) for x in words]) - 1] = False
            within = np.flatnonzero(within)
            inside[w[within], w[within + 1]] = True
            self.cuts = ~inside
        self.lasting: tuple[bytes, ...] = ()
        self._forget()

    def enter(self, words: tuple[bytes, ...]) -> None:
        """Put pieces into the table for good."""
        self.lasting = words
        self._forget()

    def _forget(self) -> None:
        self.index = HashIndex(18)
        self.clash: dict[bytes, int] = {}  # pieces whose hash another piece has
        self.head = np.zeros(1 << 16, np.uint64)  # the first eight bytes
        self.size = np.zeros(1 << 16, np.int64)
        self.from_ = np.zeros(1 << 16, np.int64)  # where the piece stands in raw
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.pool = np.zeros(1 << 18, np.uint16)
        self.raw = np.zeros(1 << 18, np.uint8)
        self.pooled = self.held = self.stay = 0
        if self.lasting:
            ends = np.cumsum([len(w) for w in self.lasting])
            self._known(np.frombuffer(b"".join(self.lasting), np.uint8), np.append(0, ends[:-1]), ends)
            self.stay, self.stay_bytes = self.index.n, self.held
        else:
            self.stay_bytes = 0

    # ---- boundaries
    def pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all pieces in order, and for each the id of the special token that it is, or -1."""
        n = len(data)
        sect = np.zeros(n + 1, bool)
        sect[offsets] = True
        marks: list[tuple[int, int, int]] = []
        if self.special:
            raw = data.tobytes()
            for word, i in self.special.items():
                at = raw.find(word)
                while at >= 0:
                    # a match must not run over the end of a text
                    if not sect[at + 1 : at + len(word)].any():
                        marks.append((at, at + len(word), i))
                        at = raw.find(word, at + len(word))
                    else:
                        at = raw.find(word, at + 1)
        for s, e, _ in marks:
            sect[s] = sect[e] = True
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = self.classes[:256][data]
        lead = np.ones(n, bool)
        high = np.flatnonzero(data >= 0x80)
        if len(high):
            lead[high] = (data[high] & 0xC0) != 0x80
            first = high[data[high] >= 0xC0]
            b = data[first].astype(np.int64)
            size = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
            at = lambda k: data[np.minimum(first + k, n - 1)].astype(np.int64) & 0x3F
            cp = np.where(size == 2, (b & 0x1F) << 6 | at(1), np.where(size == 3, (b & 0x0F) << 12 | at(1) << 6 | at(2), (b & 0x07) << 18 | at(1) << 12 | at(2) << 6 | at(3)))
            c = self.classes[np.minimum(cp, 0x10FFFF)]
            for k in range(4):
                m = size > k
                kind[np.minimum(first[m] + k, n - 1)] = c[m]
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= sect[:n]
        blank = data == 0x20
        # a space leads the run behind it
        after = np.zeros(n, bool)
        after[1:] = blank[:-1]
        start &= ~(after & (kind != SPACE) & ~sect[:n])
        # the last white space character before a run stands apart
        space = np.flatnonzero((kind == SPACE) & lead)
        if len(space):
            width = np.ones(len(space), np.int64)
            wide = data[space] >= 0xC0
            if wide.any():
                b = data[space[wide]]
                width[wide] = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
            nxt = space + width
            inside = nxt < n
            space, nxt = space[inside], nxt[inside]
            last = (kind[nxt] != SPACE) & ~sect[nxt]
            start[space[last]] = True
        # contractions: 's 't 'm 'd 're 've 'll
        q = np.flatnonzero((data == 0x27) & start)
        q = q[q + 1 < n]
        if len(q):
            q = q[~sect[q + 1]]
            one = data[q + 1]
            two = np.where((q + 2 < n) & ~sect[np.minimum(q + 2, n)], data[np.minimum(q + 2, n - 1)], 0)
            size = np.where(np.isin(one, list(b"stmd")), 2, 0)
            size[((one == 0x72) | (one == 0x76)) & (two == 0x65) | (one == 0x6C) & (two == 0x6C)] = 3
            q, size = q[size > 0], size[size > 0]
            start[q + 1] = False
            e = q + size
            e = e[e < n]
            start[e] = True
        if self.cuts is not None:
            start[1:] |= self.cuts[data[:-1], data[1:]]
        for s, e, _ in marks:
            start[s + 1 : e] = False
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        special = np.full(len(starts), -1)
        if marks:
            special[np.searchsorted(starts, [m[0] for m in marks])] = [m[2] for m in marks]
        return starts, ends, special

    # ---- merging
    def merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and how many each has. Pieces are not empty."""
        size = ends - starts
        short = size <= LONG
        lengths = np.zeros(len(starts), np.int64)
        parts: dict[int, np.ndarray] = {}
        which = np.flatnonzero(short)
        outs: list[tuple[np.ndarray, np.ndarray]] = []
        word = np.repeat(which, size[which])
        sym = self.base[data[ranges(starts[which], size[which])]]
        while len(sym):
            key = np.zeros(len(sym), np.uint64)
            same = word[1:] == word[:-1]
            key[:-1][same] = ((sym[:-1][same] << 16 | sym[1:][same]) + 1).astype(np.uint64)
            rank = np.full(len(sym), 1 << 30)
            at = np.flatnonzero(key)
            got = self.pairs.get(key[at])
            rank[at] = np.where(got < 0, 1 << 30, got)
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(sym)))
            done = np.repeat(best == 1 << 30, count)
            if done.any():
                outs.append((word[done], sym[done]))
                keep = ~done
                word, sym, rank = word[keep], sym[keep], rank[keep]
                best, count = best[best < 1 << 30], count[best < 1 << 30]
                if not len(sym):
                    break
            hit = rank == np.repeat(best, count)
            # of neighbouring hits (as in aaa) every other one, from the left
            begin = hit.copy()
            begin[1:] &= ~hit[:-1]
            pos = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(begin, pos, 0))
            hit &= (pos - run) % 2 == 0
            w = np.flatnonzero(hit)
            sym[w] = self.made[rank[w]]
            keep = np.ones(len(sym), bool)
            keep[w + 1] = False
            word, sym = word[keep], sym[keep]
        for i in np.flatnonzero(~short):
            parts[int(i)] = self._merge_long(data[starts[i] : ends[i]])
        all_word = np.concatenate([w for w, _ in outs] + [np.full(len(v), i) for i, v in parts.items()] + [np.zeros(0, np.int64)])
        all_sym = np.concatenate([s for _, s in outs] + list(parts.values()) + [np.zeros(0, np.int64)])
        order = np.argsort(all_word, kind="stable")
        np.add.at(lengths, all_word, 1) if len(all_word) < 64 else lengths.__iadd__(np.bincount(all_word, minlength=len(starts)))
        return all_sym[order].astype(np.uint16), lengths

    def _merge_long(self, piece: np.ndarray) -> np.ndarray:
        sym = self.base[piece].tolist()
        n = len(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        rank, made = self.rank, self.made
        heap = [(r, i, sym[i], sym[i + 1]) for i in range(n - 1) if (r := rank.get((sym[i] << 16 | sym[i + 1]) + 1)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = int(made[r]), -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (q := rank.get((sym[i] << 16 | sym[k]) + 1)) is not None:
                    heapq.heappush(heap, (q, i, sym[i], sym[k]))
            h = prv[i]
            if h >= 0 and (q := rank.get((sym[h] << 16 | sym[i]) + 1)) is not None:
                heapq.heappush(heap, (q, h, sym[h], sym[i]))
        return np.array([x for x in sym if x >= 0], np.int64)

    # ---- the table of pieces
    def _known(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Positions in the table of each piece; new pieces are merged and entered."""
        keys = span_hashes(data, starts, ends)
        size = ends - starts
        got = self.index.get(keys)
        new = np.flatnonzero(got < 0)
        if len(new):
            fresh, one = np.unique(keys[new], return_index=True)
            one = new[one]
            full = self.index.n + len(fresh) - self.stay > MOST_PIECES or self.held + int(size[one].sum()) - self.stay_bytes > MOST_BYTES
            if full and self.index.n > self.stay:
                self._forget()
                return self._known(data, starts, ends)
            got[new] = self._enter(self.index.add(fresh), data, starts[one], ends[one])[np.searchsorted(fresh, keys[new])]
        words = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), strides=(1,))  # the eight bytes from each place on
        bad = (self.size[got] != size) | (self.head[got] != words[starts] & _HEADS[np.minimum(size, 8)])
        k, live = 8, np.flatnonzero((size > 8) & ~bad)
        kept = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))
        while len(live):  # eight bytes at a time; the last eight may overlap the ones before
            step = np.minimum(k, size[live] - 8)
            bad[live] |= kept[self.from_[got[live]] + step] != words[starts[live] + step]
            k += 8
            live = live[(size[live] > k) & ~bad[live]]
            if k >= 64:  # few are as long: compared whole
                for i in live.tolist():
                    f = int(self.from_[got[i]])
                    bad[i] = not np.array_equal(self.raw[f : f + size[i]], data[starts[i] : ends[i]])
                break
        for i in np.flatnonzero(bad).tolist():
            word = data[starts[i] : ends[i]].tobytes()
            if word not in self.clash:
                at = np.array([self.index.n])
                self.index.n += 1
                self.clash[word] = int(self._enter(at, data, starts[i : i + 1], ends[i : i + 1])[0])
            got[i] = self.clash[word]
        return got

    def _enter(self, at: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Merge new pieces and keep their ids and bytes at consecutive positions `at`."""
        made = [self.merge(data, starts[k : k + 8192], ends[k : k + 8192]) for k in range(0, len(starts), 8192)]
        ids, lens = (np.concatenate(x) for x in zip(*made, strict=True))
        size = ends - starts
        need = int(at[-1]) + 1
        if need > len(self.at):
            grow = max(need, 2 * len(self.at))
            self.head, self.size, self.from_, self.at, self.len = (np.resize(x, grow) for x in (self.head, self.size, self.from_, self.at, self.len))
        if self.pooled + len(ids) > len(self.pool):
            self.pool = np.resize(self.pool, max(self.pooled + len(ids), 2 * len(self.pool)))
        more = int(size.sum())
        if self.held + more + 8 > len(self.raw):
            self.raw = np.resize(self.raw, max(self.held + more + 8, 2 * len(self.raw)))
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        self.at[at] = self.pooled + np.cumsum(lens) - lens
        self.len[at] = lens
        self.raw[self.held : self.held + more] = data[ranges(starts, size)]
        self.from_[at] = self.held + np.cumsum(size) - size
        self.size[at] = size
        self.head[at] = np.ndarray(len(self.raw) - 7, "<u8", self.raw, strides=(1,))[self.from_[at]] & _HEADS[np.minimum(size, 8)]
        self.pooled += len(ids)
        self.held += more
        return at

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each text's ids begin and end in them."""
        starts, ends, special = self.pieces(data, offsets)
        got = self._known(data, starts, ends)
        lens = self.len[got]
        where = self.at[got]
        if (mark := special >= 0).any():
            lens = np.where(mark, 1, lens)
        cut = np.concatenate([[0], np.cumsum(lens)])
        ids = self.pool[ranges(where, lens)]
        if mark.any():
            ids[cut[:-1][mark]] = special[mark]
        return ids, cut[np.searchsorted(starts, offsets)]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        starts, ends, special = self.pieces(data, offsets)
        got = self._known(data, starts, ends)
        lens = np.where(special >= 0, 1, self.len[got])
        cut = np.concatenate([[0], np.cumsum(lens)])
        return np.diff(cut[np.searchsorted(starts, offsets)])


def batches(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 18):
    """(data, offsets, first row, last row, whether the row goes on) in runs of about `most` bytes. A longer text is cut where every
    splitter of this kind cuts as well, so the parts encode alone: before white space behind a visible ASCII character, and
    between an ASCII letter or digit and a mark of punctuation."""
    from ._common import row_groups

    for a, b in row_groups(offsets, most):
        part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a > 1 or len(part) <= 2 * most:
            yield part, offs, a, b
            continue
        ok = np.flatnonzero(_CUT[part[:-1], part[1:]]) + 1
        cuts, at = [0], most
        while at < len(part) and (k := np.searchsorted(ok, at)) < len(ok):
            cuts.append(int(ok[k]))
            at = cuts[-1] + most
        for s, e in zip(cuts, [*cuts[1:], len(part)], strict=True):
            yield part[s:e], np.array([0, e - s]), a, b


@functools.lru_cache(maxsize=2)
def codec(spec: bytes, classes: bytes, cuts: bool) -> ByteLevelBPE:
    """One per Python worker."""
    return ByteLevelBPE(spec, classes, cuts)
