"""Cross-tokenizer alignment with corpus-wide pair counts in packed int64 keys: op11.

Every text, with a space put before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback (B). Both
cover the same bytes, so their tokens' ends cut a text into groups wherever they coincide; the two tokens that end there are a link.
A link is one int64, B's id << 32 | A's id.

1. Texts are encoded once; numbers and links are stored. They are cut before spaces that follow a letter, digit or ASCII mark: A's splitter
   always cuts there, and no entry of B's vocabulary goes on over the start of a space (which is proved from the vocabulary), so B's merges
   don't either. Both have a token's end there, so the groups of a text are those of its parts; parts met before come from a table.
2. np.unique gives partial counts for each partition, so a pair has one row for each task and not one for each link.
3. The partial counts are sorted globally by ranges of the key, and runs of equal keys summed. Each range writes its keys and counts as a shard
   of two arrays below the shared folder; the driver gets a line for each shard, and for each of B's ids its highest count (at most B's
   vocabulary for each shard that it is in).
4. Links are looked up in the shards by searchsorted, in files mapped into memory: a worker touches the pages it needs, and all
   workers of a machine share them. Where the shared folder is no file system of the machine, a shard is fetched when it is needed first.

A shard's name is new for every attempt to write it, and only names that finished tasks have reported are read; a lost executor costs
nothing but its tasks.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytelevel import ByteLevelBPE, batches
from ._common import discard, ready, released, remove, shared_dir, stored, table
from .tokens import codec_parts, vocabulary_path

PIECES = "piece_bpe_32k.model"
SPACE = "▁"
#: Distinct pairs that a task holds before it hands on what it has counted.
MOST_PAIRS = 1 << 20
#: Partial counts in a shard, about: two arrays of 8 MB.
SHARD_ROWS = 1 << 20
#: Parts of texts that a worker keeps, and the longest of them, in characters.
MOST_PARTS, LONG = 150_000, 48
#: Shards that a worker keeps open.
MOST_OPEN = 512


@functools.lru_cache(maxsize=2)
def _plain(spec: bytes, classes: bytes) -> ByteLevelBPE:
    """A's codec, for which the strings of special tokens are plain text."""
    m = ByteLevelBPE(spec, classes, True)
    m.special = {}
    return m


class Pieces:
    """B: ids and the bytes of its tokens."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.size = np.array([len(b) for b in self.bytes_of])
        # merges only make entries: where none goes on over the start of a space, texts can be cut there
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for i, p in enumerate(names) if not self.sp.is_control(i) and not self.sp.is_unknown(i))
        self.space = self.sp.piece_to_id(SPACE)

    def encode(self, parts: list[str]) -> list[list[int]]:
        """The ids of each part with a space before it."""
        return [ids if t else [self.space] for t, ids in zip(parts, self.sp.encode(parts, num_threads=1), strict=True)]


@functools.lru_cache(maxsize=2)
def _pieces(model: bytes) -> Pieces:
    return Pieces(model)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The last token of A and of B in every group, from the ends of all tokens."""
    _, a, b = np.intersect1d(ends_a, ends_b, assume_unique=True, return_indices=True)
    return a, b


def spelled(a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> list[str]:
    """`a1,a2|b1` for the ids of A and of B in each group."""
    na, nb = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    before_a, before_b = np.cumsum(nb) - nb, np.cumsum(na)
    out = np.empty(2 * (len(a) + len(b)), object)
    at_a, at_b = np.arange(len(a)) + np.repeat(before_a, na), np.arange(len(b)) + np.repeat(before_b, nb)
    out[2 * at_a] = list(map(str, a.tolist()))
    out[2 * at_b] = list(map(str, b.tolist()))
    out[1::2] = ","
    out[2 * at_a[last_a] + 1] = "|"
    out[2 * at_b[last_b] + 1] = ";"
    return "".join(out[:-1].tolist()).split(";")


#: A space behind an ASCII character that shows, or a letter or digit: A's splitter cuts before it, and so does B if its vocabulary allows.
_CUT = re.compile(r" (?<=[!-~\w] )")
_NO_CUT = re.compile(r" (?<![!-~\w] )")


class Aligner:
    """Groups and links of texts, put together from those of their parts. Parts met before come from a table."""

    def __init__(self, m: ByteLevelBPE, p: Pieces):
        self.m, self.p = m, p
        self.size_a = np.array([len(b) for b in m.bytes_of])
        self.known: dict[str, tuple[int, int, tuple[int, ...], str] | None] = {}

    def parts(self, text: str) -> list[str]:
        """Each stands for a space and itself."""
        if not self.p.cuts:
            return [text]
        return _CUT.split(text) if _NO_CUT.search(text) else text.split(" ")

    def learn(self, parts: list[str]) -> dict[str, tuple[int, int, tuple[int, ...], str] | None]:
        """(number of A's tokens, of B's, links, groups spelled) of parts; None where the tokens have other bytes."""
        raw = [b" " + x.encode() for x in parts]
        of_b = self.p.encode(parts)
        good = [b"".join(map(self.p.bytes_of.__getitem__, ids)) == x for ids, x in zip(of_b, raw, strict=True)]
        out = dict.fromkeys(x for x, ok in zip(parts, good, strict=True) if not ok)
        parts, raw, of_b = ([v for v, ok in zip(some, good, strict=True) if ok] for some in (parts, raw, of_b))
        if not parts:
            return out
        offsets = np.append(0, np.cumsum([len(x) for x in raw]))
        data = np.frombuffer(b"".join(raw), np.uint8)
        n_a, ids = np.zeros(len(parts), np.int64), []
        for piece, offs, first, last in batches(data, offsets):
            got, cut = self.m.encode(piece, offs)
            ids.append(got)
            n_a[first:last] += np.diff(cut)
        a, b = np.concatenate(ids).astype(np.int64), np.fromiter(itertools.chain.from_iterable(of_b), np.int64)
        # all parts at once: each ends with an end of both
        last_a, last_b = groups(np.cumsum(self.size_a[a]), np.cumsum(self.p.size[b]))
        links, said = (b[last_b] << 32 | a[last_a]).tolist(), spelled(a, b, last_a, last_b)
        at_a, at_g = np.cumsum(n_a), 0
        in_part = np.searchsorted(last_a, at_a).tolist()  # groups up to the end of each part
        for k, (x, n) in enumerate(zip(parts, n_a.tolist(), strict=True)):
            to = in_part[k]
            out[x] = n, len(of_b[k]), tuple(links[at_g:to]), ";".join(said[at_g:to])
            at_g = to
        return out

    def __call__(self, texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, str] | None]:
        """For each text its numbers of tokens, links and groups; None if it has no tokens."""
        cut = [self.parts(t) if t else None for t in texts]
        known = self.known
        if len(known) > MOST_PARTS:
            known.clear()
        new = list(set().union(*(c for c in cut if c)).difference(known))
        met = self.learn(new) if new else {}
        known.update((k, v) for k, v in met.items() if len(k) <= LONG)
        far = {k: v for k, v in met.items() if len(k) > LONG}
        for c in cut:
            if c is None:
                yield None
                continue
            got = [known[x] if x in known else far[x] for x in c] if far else [known[x] for x in c]
            if None in got:
                yield None
                continue
            na, nb, links, said = zip(*got, strict=True)
            n_a = sum(na)
            yield n_a, sum(nb), np.fromiter(itertools.chain.from_iterable(links), np.int64), ";".join(said)


@functools.lru_cache(maxsize=2)
def _aligner(spec: bytes, classes: bytes, model: bytes) -> Aligner:
    """One per Python worker."""
    return Aligner(_plain(spec, classes), _pieces(model))


def aligned(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None, spell: bool = False) -> DataFrame:
    """Adds n_a, n_b, n_groups, groups_sha256 and links (array<bigint>, one for each group, B's id << 32 | A's id), and if asked groups.

    A text that is null or empty, or that either vocabulary does not give back byte for byte, has no tokens: numbers of zero, no links, and ''
    for the digest. Texts of any length are aligned whole, repeated rows each; an empty table gives no rows. Columns of these names
    that df has already are replaced.
    """
    spark = df.sparkSession
    ready(spark)
    spec, classes = codec_parts(spark, path_a or vocabulary_path())
    with open(path_b or vocabulary_path(PIECES), "rb") as f:
        model = spark.sparkContext.broadcast(f.read())  # 0.5 MB, fixed by the vocabulary
    names = {"n_a": "bigint", "n_b": "bigint", "n_groups": "bigint", "groups_sha256": "string", "links": "array<bigint>"} | ({"groups": "string"} if spell else {})
    df = df.drop(*names)
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in names.items()]).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(spec.value, classes.value, model.value)
        for batch in it:
            cols: list[list] = [[] for _ in names]
            for got in align(batch.column(batch.schema.get_field_index(text)).to_pylist()):
                values = (0, 0, 0, "", [], "")
                if got is not None:
                    n_a, n_b, links, said = got
                    values = (n_a, n_b, len(links), hashlib.sha256(said.encode()).hexdigest(), links, said)
                for c, v in zip(cols, values, strict=False):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=False))], [*batch.schema.names, *names])

    return df.mapInArrow(released(run), schema)


# ---- counts
def _open(uri: str, dtype: str, rows: int) -> np.ndarray:
    """A shard's file mapped into memory. From another kind of store it is fetched into a file that is unlinked at once."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return np.memmap(unquote(u.path), dtype, "r", shape=(rows,))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    fd, local = tempfile.mkstemp()
    try:
        with store.open_input_stream(path) as src, os.fdopen(fd, "wb") as to:
            while part := src.read(1 << 20):
                to.write(part)
        return np.memmap(local, dtype, "r", shape=(rows,))
    finally:
        os.unlink(local)  # what is mapped stays readable


def _save(uri: str, x: np.ndarray) -> None:
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        os.makedirs(os.path.dirname(unquote(u.path)), exist_ok=True)
        with open(unquote(u.path), "wb") as f:
            f.write(x.tobytes())
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(x.tobytes())


def partial_counts(df: DataFrame, links: str = "links") -> DataFrame:
    """(key, n): np.unique counts of all links of a partition, in bounded memory: a task that has met MOST_PAIRS hands them on and starts anew."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[np.ndarray] = []
        waiting = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            one, count = np.unique(np.concatenate(held), return_counts=True)
            both, at = np.unique(np.concatenate([keys, one]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([n, count])).astype(np.int64)

        for batch in it:
            held.append(np.asarray(batch.column(0).flatten()))
            waiting += len(held[-1])
            if waiting >= 1 << 20:
                keys, n = merged()
                held, waiting = [], 0
                if len(keys) >= MOST_PAIRS:
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])
                    keys, n = keys[:0], n[:0]
        if held:
            keys, n = merged()
        if len(keys):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    return df.select(links).mapInArrow(released(run), "key bigint, n bigint")


class Shards:
    """Sorted keys with their counts, in ascending files of an array of keys and one of counts each. lines: (first key, rows, URI)."""

    def __init__(self, lines: list[tuple[int, int, str]], top: np.ndarray):
        self.lines, self.top = sorted(lines), top
        self.first = np.array([x[0] for x in self.lines], np.int64)
        self.maps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __getstate__(self):
        return self.lines, self.top

    def __setstate__(self, state):
        self.__init__(*state)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of ascending keys, 0 for those that are not there."""
        out = np.zeros(len(keys), np.int64)
        if not self.lines or not len(keys):
            return out
        shard = np.searchsorted(self.first, keys, side="right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            if k not in self.maps:
                if len(self.maps) >= MOST_OPEN:
                    self.maps.clear()
                _, rows, uri = self.lines[k]
                self.maps[k] = _open(uri + ".keys", "<i8", rows), _open(uri + ".counts", "<i8", rows)
            mine = np.flatnonzero(shard == k)
            all_keys, counts = self.maps[k]
            at = np.minimum(np.searchsorted(all_keys, keys[mine]), len(all_keys) - 1)
            hit = all_keys[at] == keys[mine]
            out[mine[hit]] = counts[at[hit]]
        return out


def count_shards(partial: DataFrame, ids: int) -> tuple[Shards, str]:
    """Sums stored partial counts into shards below the shared folder; ids: how many ids the upper half of a key can have. The folder is
    the caller's to remove."""
    spark = partial.sparkSession
    root = f"{shared_dir(spark).rstrip('/')}/assaywright/pair-shards-{uuid.uuid4().hex}"
    rows = partial.count()
    ordered = partial.repartitionByRange(max(1, -(-rows // SHARD_ROWS)), "key").sortWithinPartitions("key")

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = [], []
        for batch in it:  # runs of equal keys, of which the last may go on
            k, c = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if not len(k):
                continue
            start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            sums = np.add.reduceat(c, start)
            k = k[start]
            if keys and keys[-1][-1] == k[0]:
                n[-1][-1] += sums[0]
                k, sums = k[1:], sums[1:]
            if len(k):
                keys.append(k)
                n.append(sums)
        if not keys:
            return
        keys, n = np.concatenate(keys), np.concatenate(n)
        uri = f"{root}/{uuid.uuid4().hex}"
        _save(uri + ".keys", keys.astype("<i8"))
        _save(uri + ".counts", n.astype("<i8"))
        upper = keys >> 32
        start = np.flatnonzero(np.append(True, upper[1:] != upper[:-1]))
        lists = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys[:1]), pa.array([len(keys)]), pa.array([uri]), pa.array([upper[start]], lists), pa.array([np.maximum.reduceat(n, start)], lists)], ["first", "rows", "uri", "id", "top"])

    lines = ordered.mapInArrow(released(write, 1 << 16), "first bigint, rows bigint, uri string, id array<bigint>, top array<bigint>").collect()  # a line for each shard
    top = np.zeros(ids, np.int64)
    for x in lines:
        np.maximum.at(top, np.array(x["id"], np.int64), np.array(x["top"], np.int64))
    return Shards([(x["first"], x["rows"], x["uri"]) for x in lines], top), root


def link_strengths(df: DataFrame, shards: Shards, links: str = "links") -> DataFrame:
    """Adds n_links, n_best (links whose count is the highest of their B id) and count_sum to stored rows with links, and takes links out."""
    names = ["n_links", "n_best", "count_sum"]
    shared = df.sparkSession.sparkContext.broadcast(shards)  # a line for each shard, a number for each of B's ids
    schema = df.drop(links, *names).select("*", *[F.lit(0).cast("bigint").alias(c) for c in names]).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in it:
            col = batch.column(batch.schema.get_field_index(links))
            size = np.asarray(col.value_lengths().fill_null(0)).astype(np.int64)
            every = np.asarray(col.flatten())
            keys, at = np.unique(every, return_inverse=True)
            count = s.get(keys)[at]
            best = count == s.top[every >> 32]
            sums = [np.append(0, np.cumsum(x)) for x in (count, best)]
            cut = np.append(0, np.cumsum(size))
            total, n_best = (x[cut[1:]] - x[cut[:-1]] for x in sums)
            keep = [i for i, x in enumerate(batch.schema.names) if x != links and x not in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(size), pa.array(n_best.astype(np.int64)), pa.array(total)], [*(batch.schema.names[i] for i in keep), *names])

    return df.mapInArrow(released(run), schema)


def alignment(df: DataFrame, text: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """df without its texts, with n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256; counts are over the whole of df.

    As aligned() for null, empty, very long and repeated texts and clashing names. Intermediate tables and the shards lie below the shared
    folder; those that the result does not read are removed.
    """
    rows = stored(aligned(df, text, path_a, path_b).drop(text), "aligned")
    partial = stored(partial_counts(rows), "pair-counts")
    with open(path_b or vocabulary_path(PIECES), "rb") as f:
        ids = len(_pieces(f.read()).size)
    shards, root = count_shards(partial, ids)
    discard(partial)
    out = stored(link_strengths(rows, shards), "alignment")
    discard(rows)
    remove(df.sparkSession, root)
    return out


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the two vocabularies' tokens in every document, and how frequent their pairs are in all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
