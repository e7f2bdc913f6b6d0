r"""Byte-level BPE encoding and decoding through a transducer of frequent words.

One pass counts the corpus's words (the pieces that the byte-level pattern cuts).
Words that make up at least 1/``SHARE`` of all occurrences, so at most ``SHARE`` of
them, are compiled into a minimal acyclic transducer: states with equal futures are
merged, so suffixes are shared, and the numbers on the arcs of a word's path add up
to the word's place in the table of token ids. The file (a few MB) goes to the
executors with ``SparkContext.addFile`` and is memory-mapped there. Words outside it
are merged exactly by rank. A worker looks up and merges the words that are new to it
for a slice of texts at once: one array step follows an arc, or makes a merge, in every
word that is not yet done. Results do not depend on which words the transducer holds.

Defined results: a null or empty text has no tokens and decodes to the empty text;
texts are encoded whole; the added tokens of the vocabulary file are matched in the
text first, as the tokenizers library does; rows are independent, so repeated rows
and null ids stay as they are; only ``keep`` columns and the text are read.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import struct
import tempfile
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.session import stage

#: Fixed value: the cutting pattern of byte-level BPE.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of ASCII only, where a simpler engine is faster.
ASCII_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: A word is compiled when it is at least 1/SHARE of all words: at most so many words.
SHARE = 50_000
#: Longest word (UTF-8 bytes) that is compiled; entries of a generation of a worker's word cache.
WORD_BYTES, CACHED = 48, 250_000
#: Up to so many bytes words are merged in lockstep; longer ones one by one, with a heap.
LOCKSTEP = 40
#: Stands for a pair that never merges; above every rank.
NO_PAIR = (1 << 31) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks over token ids, token bytes and added tokens of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids: dict[str, int] = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        self.first = [ids[c] for c in byte_letters()]
        self.ranks: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []  # by rank
        self._tables = None
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((ids[a], ids[b]), rank)
            self.merged.append(ids[a + b])
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        by_id = {i: t for t, i in ids.items()} | {i: t for t, i in self.added.items()}
        self.token_bytes = [b""] * (max(by_id) + 1)
        for i, t in by_id.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode()
        names = sorted(self.added, key=len, reverse=True)
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, names)) + ")") if names else None

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: of all adjacent pairs the lowest rank, leftmost, merges first; O(n log n)."""
        tok = [self.first[b] for b in word]
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks, merged = self.ranks, self.merged
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := ranks.get((tok[i], tok[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue  # one of the two has merged since
            tok[i], tok[j] = merged[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get((tok[i], tok[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, tok[i], tok[after[i]]))
            if (h := before[i]) >= 0 and (r := ranks.get((tok[h], tok[i]))) is not None:
                heapq.heappush(heap, (r, h, tok[h], tok[i]))
        return [t for t in tok if t >= 0]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of token ids, NO_PAIR where it never merges."""
        if self._tables is None:
            pairs = np.array([a << 32 | b for a, b in self.ranks] or [-1], np.int64)
            order = np.argsort(pairs)
            self._tables = pairs[order], np.array(list(self.ranks.values()) or [NO_PAIR], np.int64)[order], np.array(self.merged or [0], np.int64)
        pairs, ranks, _ = self._tables
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(pairs, wanted), len(pairs) - 1)
        return np.where(pairs[at] == wanted, ranks[at], NO_PAIR)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Packed token ids of many words: every step makes the lowest, leftmost merge of each word that still has one."""
        out: list[bytes] = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > LOCKSTEP:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
        word = np.array([i for i, w in enumerate(words) if 0 < len(w) <= LOCKSTEP], np.int64)
        if not len(word):
            return out
        size = np.array([len(words[i]) for i in word])
        tok = np.array(self.first, np.int64)[np.frombuffer(b"".join(words[i] for i in word), np.uint8)]
        start = np.cumsum(size) - size
        rank = np.full(len(tok), NO_PAIR, np.int64)  # of a token and its right neighbour
        inner = np.ones(len(tok), bool)
        inner[start + size - 1] = False
        left = np.flatnonzero(inner)
        rank[left] = self.pair_ranks(tok[left], tok[left + 1])
        while len(word):
            # rank above, place below: the minimum is the lowest rank's leftmost place
            best = np.minimum.reduceat(rank << 32 | np.arange(len(tok)), start)
            low, place = best >> 32, best & 0xFFFFFFFF
            done = low == NO_PAIR
            if done.any():
                packed = tok.astype("<u4").tobytes()
                for i, a, n in zip(word[done].tolist(), start[done].tolist(), size[done].tolist()):
                    out[i] = packed[4 * a:4 * (a + n)]
            go = ~done
            stay = np.repeat(go, size)
            at, begin = place[go], start[go]
            if len(at):
                tok[at] = self._tables[2][low[go]]
                stay[at + 1] = False
            moved = np.cumsum(stay) - 1  # where a kept token is from now on
            tok, rank, word, size = tok[stay], rank[stay], word[go], size[go] - 1
            start = np.cumsum(size) - size
            if not len(word):
                break
            at, last = moved[at], start + size - 1
            rank[last] = NO_PAIR
            for here in (at[at < last], at[at > start] - 1):
                rank[here] = self.pair_ranks(tok[here], tok[here + 1])
        return out


# --- the transducer -------------------------------------------------------------

def compile_words(words: dict[bytes, list[int]]) -> bytes:
    """A minimal acyclic transducer of ``words``, as the bytes of a file that ``Transducer`` maps.

    Sorted words are added one by one; when a branch is left for good, its states
    are replaced by registered states with the same futures. A state's ``size`` is
    the number of words below it; an arc carries the number of words that come
    before it in the state, so the sum along a path is the word's sorted place.
    """
    order = sorted(words)
    root: list = [False, {}]  # final, arcs in label order
    register: dict[tuple, list] = {}
    open_path = [root]
    last = b""

    def close(down_to: int) -> None:
        while len(open_path) > down_to + 1:
            state = open_path.pop()
            label = last[len(open_path) - 1]
            key = (state[0], tuple((c, id(t)) for c, t in state[1].items()))
            open_path[-1][1][label] = register.setdefault(key, state)

    for w in order:
        same = len(os.path.commonprefix([w, last]))
        close(same)
        for c in w[same:]:
            state = [False, {}]
            open_path[-1][1][c] = state
            open_path.append(state)
        open_path[-1][0] = True
        last = w
    close(0)

    number: dict[int, int] = {}
    states: list[list] = []
    below: list[int] = []
    stack = [(root, False)]
    while stack:  # children first
        state, done = stack.pop()
        if id(state) in number:
            continue
        if not done:
            stack.append((state, True))
            stack.extend((t, False) for t in state[1].values())
            continue
        number[id(state)] = len(states)
        states.append(state)
        below.append(state[0] + sum(below[number[id(t)]] for t in state[1].values()))
    labels, starts, targets, adds = bytearray(), [0], [], []
    for state in states:
        passed = int(state[0])
        for c, t in state[1].items():
            labels.append(c)
            targets.append(number[id(t)])
            adds.append(passed)
            passed += below[number[id(t)]]
        starts.append(len(labels))
    id_starts = np.cumsum([0, *(4 * len(words[w]) for w in order)], dtype="<u4")
    blobs = [np.array(starts, "<u4").tobytes(), bytes(s[0] for s in states), bytes(labels), np.array(targets, "<u4").tobytes(),
             np.array(adds, "<u4").tobytes(), id_starts.tobytes(), b"".join(np.array(words[w], "<u4").tobytes() for w in order)]
    blobs = [b + bytes(-len(b) % 4) for b in blobs]
    ends = np.cumsum([36, *map(len, blobs)])
    return struct.pack("<9I", number[id(root)], *ends) + b"".join(blobs)


class Transducer:
    """A compiled word table, memory-mapped: word -> packed token ids, or None."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *cut = struct.unpack_from("<9I", self.map)
        part = lambda k, kind="<u4": np.frombuffer(self.map, kind, (cut[k + 1] - cut[k]) // np.dtype(kind).itemsize, cut[k])
        starts, self.final, self.targets, self.adds, self.id_starts = part(0).astype(np.int64), part(1, "u1"), part(3), part(4), part(5)
        self.ids = cut[6]
        # arcs in order of state and label, so one search finds an arc
        self.arcs = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 8 | part(2, "u1")[:starts[-1]]

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """All words at once: a step follows one arc in every word that is still on a path."""
        out: list[bytes | None] = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.flatnonzero((size > 0) & (size <= WORD_BYTES))
        start = np.cumsum(size) - size
        state, place = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64)
        step = 0
        while len(live) and len(self.arcs):
            wanted = state << 8 | data[start[live] + step]
            at = np.minimum(np.searchsorted(self.arcs, wanted), len(self.arcs) - 1)
            on = self.arcs[at] == wanted
            live, at = live[on], at[on]
            state, place = self.targets[at].astype(np.int64), place[on] + self.adds[at]
            step += 1
            ends = size[live] == step
            word = ends & (self.final[state] > 0)
            for i, p in zip(live[word].tolist(), place[word].tolist()):
                out[i] = self.map[self.ids + int(self.id_starts[p]):self.ids + int(self.id_starts[p + 1])]
            live, state, place = live[~ends], state[~ends], place[~ends]
        return out

    def get(self, word: bytes) -> bytes | None:
        return self.get_all([word])[0]


class Words(dict):
    """Word -> packed ids: from the transducer, else merged.

    When it is full it becomes the older generation and starts anew; words that
    come up again move over from there, so frequent words are never lost.
    """

    def __init__(self, vocabulary: Vocabulary, transducer: Transducer):
        super().__init__()
        self.vocabulary, self.transducer, self.older = vocabulary, transducer, {}

    def learn(self, words: set[str]) -> list[str]:
        """Make every one of ``words`` an entry; the long ones that are new, not to be kept beyond their slice."""
        if len(self) >= CACHED:
            self.older = dict(self)
            self.clear()
        new = [w for w in words if w not in self]
        known = self.older
        self.update((w, known[w]) for w in new if w in known)
        new = [w for w in new if w not in known]
        raw = [w.encode() for w in new]
        ids = self.transducer.get_all(raw)
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(rest, self.vocabulary.merge_all([raw[i] for i in rest])):
            ids[i] = x
        self.update(zip(new, ids))
        return [w for w in new if len(w) > WORD_BYTES]

    def forget(self) -> None:
        """Hold no word: workers that wait for other tasks keep the vocabulary only."""
        self.clear()
        self.older = {}


def piece_cutter():
    """text -> its pieces."""
    plain, full = re.compile(ASCII_PIECES, re.ASCII).findall, regex.compile(PIECES).findall
    return lambda text: plain(text) if text.isascii() else full(text)


class Codec:
    """Encoding and decoding of whole texts in one worker."""

    def __init__(self, vocabulary_path: str, words_path: str):
        self.vocabulary = Vocabulary(vocabulary_path)
        self.words = Words(self.vocabulary, Transducer(words_path))
        self.cut = piece_cutter()

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; the words that are new are looked up and merged for all texts at once."""
        v, cut, look = self.vocabulary, self.cut, self.words.__getitem__
        cuts = []
        for text in texts:
            if not text:
                cuts.append(())
            elif v.split_added and any(a in text for a in v.added):
                # pieces of plain text, and added tokens between them
                cuts.append([v.added[p] if k % 2 else cut(p) for k, p in enumerate(v.split_added.split(text))])
            else:
                cuts.append([cut(text)])
        words = set().union(*(p for parts in cuts for p in parts if type(p) is list))
        long = self.words.learn(words)
        out = [b"".join([struct.pack("<I", p) if type(p) is int else b"".join(map(look, p)) for p in parts]) for parts in cuts]
        for word in long:
            del self.words[word]
        return out

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.token_bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_CODECS: dict[tuple[str, str], Codec] = {}


def _codec(vocabulary_name: str, words_name: str) -> Codec:
    """The worker's codec, read once from the files that Spark has sent."""
    key = (vocabulary_name, words_name)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(SparkFiles.get(vocabulary_name), SparkFiles.get(words_name))
    return _CODECS[key]


# --- the Spark side -----------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts; a task sums in bounded memory before the shuffle."""
    def count(batches):
        find, held = piece_cutter(), Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for part in text_slices(batches, "text"):
            for text in part.column("text").to_pylist():
                if text:
                    held.update(find(text))
            if len(held) > 200_000:
                yield flush()
        yield flush()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def build_words(docs: DataFrame, vocabulary_path: str, share: int = SHARE) -> str:
    """Compile the frequent words of ``docs``, send the file to the executors; its name there."""
    spark = docs.sparkSession
    counts = stage(word_counts(docs), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = (counts.where((F.col("n") * share >= total) & (F.octet_length("word") <= WORD_BYTES))
            .select("word").collect())  # at most `share` words of at most WORD_BYTES bytes
    vocabulary = Vocabulary(vocabulary_path)
    blob = compile_words({(w := r.word.encode()): vocabulary.merge(w) for r in rows})
    name = f"words-{uuid.uuid4().hex[:12]}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="srcindex-words-"), name)
    with open(path, "wb") as f:
        f.write(blob)
    spark.sparkContext.addFile(path)
    return name


def bpe(docs: DataFrame, vocabulary_path: str, keep: tuple[str, ...] = ("doc_id",), share: int = SHARE) -> DataFrame:
    """``keep`` columns, n_tokens, ids (unsigned 32-bit little-endian, packed) and decoded text of every row."""
    spark = docs.sparkSession
    words = build_words(docs, vocabulary_path, share)
    vocabulary = os.path.basename(vocabulary_path)
    spark.sparkContext.addFile(vocabulary_path)

    def run(batches):
        codec = _codec(vocabulary, words)
        try:
            for part in text_slices(batches, "text"):
                ids = codec.encode_all(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()),
                     pa.array([codec.decode(x) for x in ids], pa.string())], names=[*keep, "n_tokens", "ids", "decoded"])
        finally:
            codec.words.forget()

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long, ids binary, decoded string"])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op6_bpe")
def op6_bpe(spark, sf_dir):
    return (bpe(table(spark, sf_dir, "documents"), default_vocabulary())
            .select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")))
