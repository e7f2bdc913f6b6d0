r"""Cross-tokenizer alignment by lockstep vectorised merging.

Vocabulary A is the byte-level BPE, vocabulary B the sentence pieces. A text's two
token lists cover the same bytes (a space and the text), so they are merged by their
byte ends: a pointer into A and one into B, a link at every state, and a step of the
pointer whose token ends first, or of both where they end together (a cut). One NumPy
state vector holds the pointers of all documents of a batch, and every step advances
all of them at once; finished ones are compacted away. A long document takes several
places in the vector: the merge passes each start x of an A token in the state (that
token, first B token that ends after x), so a binary search finds where a lane begins,
and it ends where the next one began. Steps are thus bounded by ``LANE``, however long
a text is.

The first pass stages one row per document with its counts, its groups' digest and
its id pairs with their numbers of links. Pairs are summed over the corpus; those
that make up at least 1/``SHARE`` of all links (at most ``SHARE`` of them) are
broadcast and settled in place, the links of all others travel to their pair's total.

Defined results: null and empty texts and texts whose tokens do not give back their
bytes (U+2581 in the text) have no tokens: zeros and an empty digest. Strings of special
tokens are plain text. Rows are independent, so repeated rows and null ids stay and all
count; an empty table gives no rows; other columns than ``keep`` and the text are not
read. ``keep`` must not use the names of the result's own columns.
"""

from __future__ import annotations

import base64
import hashlib
import os

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcindex.llm.common import query, table, text_slices
from srcindex.session import checkpoint_root, stage

#: Fixed value: the cutting pattern of byte-level BPE.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most A tokens that one place of the state vector merges.
LANE = 256
#: A pair is broadcast when it has at least 1/SHARE of all links: at most so many pairs (17 bytes each).
SHARE = 500_000
#: Longest text in characters that the fast encoder gets; longer ones go to the other library, with equal ids.
FAST = 200_000


# --- tokens ---------------------------------------------------------------------

class Tokenizers:
    """The two vocabularies: encoding, and the bytes of every id."""

    def __init__(self, json_path: str, rank_path: str, piece_path: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(rank_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("a", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(json_path)
        self.slow.encode_special_tokens = True
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        by_id = {i: t for t, i in ranks.items()}
        self.a = ByteTable([by_id.get(i, b"") for i in range(self.slow.get_vocab_size())])
        self.b = ByteTable([self.piece(i) for i in range(self.pieces.get_piece_size())])

    def piece(self, i: int) -> bytes:
        text = self.pieces.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if self.pieces.is_byte(i) else text.replace("▁", " ").encode()

    def encode_a(self, text: str) -> np.ndarray:
        """Ids of a space and the text. The fast library holds the same ranks, but may refuse texts without end."""
        if len(text) <= FAST:
            return self.fast.encode_to_numpy(" " + text)
        return np.array(self.slow.encode(" " + text, add_special_tokens=False).ids, np.uint32)

    def encode_b(self, texts: list[str]) -> list[list[int]]:
        return self.pieces.encode(texts, num_threads=1)


class ByteTable:
    """Byte strings by number, joined in one array operation."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.all = np.frombuffer(b"".join(entries), np.uint8)

    def join(self, numbers: np.ndarray) -> np.ndarray:
        size = self.size[numbers]
        ends = np.cumsum(size)
        if not len(ends):
            return np.empty(0, np.uint8)
        shift = np.repeat(self.start[numbers] - (ends - size), size)
        shift += np.arange(ends[-1])
        return self.all[shift]


_LOADED: dict[tuple[str, ...], Tokenizers] = {}


def _tokenizers(names: tuple[str, ...]) -> Tokenizers:
    """The worker's vocabularies, read once from the files that Spark has sent."""
    if names not in _LOADED:
        _LOADED.clear()
        _LOADED[names] = Tokenizers(*map(SparkFiles.get, names))
    return _LOADED[names]


# --- the merge --------------------------------------------------------------------

def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, starts_a: np.ndarray, lane: int = LANE):
    """Links and cuts of documents laid end to end.

    ``ends_a`` and ``ends_b`` are the tokens' byte ends, running on over all documents,
    which end together in both; ``starts_a`` has each document's first A token. Returns
    the linked token numbers (a, b) and the last token numbers (a, b) before each cut,
    in no order.
    """
    n_a = len(ends_a)
    none = np.empty(0, np.int64)
    if not n_a:
        return none, none, none, none
    begin = np.unique(np.concatenate([starts_a, np.arange(0, n_a, lane)]))
    stop = np.append(begin[1:], n_a)
    offset = np.where(begin > 0, ends_a[begin - 1], 0)
    a, b = begin.copy(), np.searchsorted(ends_b, offset, side="right")  # the state vector
    links_a, links_b, cuts_a, cuts_b = [], [], [], []
    while len(a):
        links_a.append(a)
        links_b.append(b)
        ea, eb = ends_a[a], ends_b[b]
        step_a, step_b = ea <= eb, eb <= ea
        both = step_a & step_b
        cuts_a.append(a[both])
        cuts_b.append(b[both])
        a, b = a + step_a, b + step_b
        live = a < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    return tuple(map(np.concatenate, (links_a, links_b, cuts_a, cuts_b)))


DIGITS = ByteTable([str(i).encode() + sep for sep in (b",", b"|", b";", b"") for i in range(1 << 16)])


def group_text(a: np.ndarray, b: np.ndarray, cut_a: np.ndarray, cut_b: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The groups' text of all documents end to end, and each document's end in it.

    ``cut_a``, ``cut_b``: sorted last token numbers of the groups; ``last``: each
    document's last group. Ids below 65,536.
    """
    size_a, size_b = np.diff(cut_a, prepend=-1), np.diff(cut_b, prepend=-1)
    group_at = np.cumsum(size_a + size_b) - size_a - size_b
    out = np.empty(len(a) + len(b), np.int64)
    at_a = np.arange(len(a)) + np.repeat(group_at - (cut_a + 1 - size_a), size_a)
    at_b = np.arange(len(b)) + np.repeat(group_at + size_a - (cut_b + 1 - size_b), size_b)
    out[at_a], out[at_b] = a, b
    ends = group_at + size_a + size_b - 1
    out[ends - size_b] += 1 << 16
    out[ends] += 2 << 16
    out[ends[last]] += 1 << 16
    stops = np.cumsum(DIGITS.size[out])[ends[last]]
    return DIGITS.join(out), stops


def align(tokenizers: Tokenizers, texts: list[str | None]) -> dict[str, list | np.ndarray]:
    """Counts, digest, id pairs (a << 32 | b) and their numbers of links, for every text."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    digest = [""] * n
    pairs, times = [np.empty(0, np.int64)] * n, [np.empty(0, np.int64)] * n
    rows = [i for i, t in enumerate(texts) if t]
    ids_a = [tokenizers.encode_a(texts[i]) for i in rows]
    ids_b = [np.array(x, np.int64) for x in tokenizers.encode_b([texts[i] for i in rows])]
    if rows:  # texts that do not come back byte for byte go
        raw = [(" " + texts[i]).encode() for i in rows]
        keep = np.ones(len(rows), bool)
        for ids, tab in ((ids_a, tokenizers.a), (ids_b, tokenizers.b)):
            whole = tab.join(np.concatenate(ids)).tobytes()
            at = 0
            for k, x in enumerate(ids):
                size = int(tab.size[x].sum())
                keep[k] &= whole[at:at + size] == raw[k]
                at += size
        rows, ids_a, ids_b = ([x for x, ok in zip(xs, keep) if ok] for xs in (rows, ids_a, ids_b))
    if rows:
        size_a, size_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
        a, b = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b)
        stop_a = np.cumsum(size_a)
        link_a, link_b, cut_a, cut_b = lockstep(np.cumsum(tokenizers.a.size[a]), np.cumsum(tokenizers.b.size[b]), stop_a - size_a)
        order = np.argsort(cut_a)
        cut_a, cut_b = cut_a[order], cut_b[order]
        last = np.searchsorted(cut_a, stop_a - 1)  # a document ends with a cut
        text, stops = group_text(a, b, cut_a, cut_b, last)
        doc = np.repeat(np.arange(len(rows)), size_a)[link_a]
        where = np.array(rows)
        out["n_a"][where], out["n_b"][where] = size_a, size_b
        out["n_groups"][where] = np.diff(last, prepend=-1)
        out["n_links"][where] = np.bincount(doc, minlength=len(rows))
        # pairs of each document: one number per (document, pair of this batch)
        code, known = pd.factorize(a[link_a] << 32 | b[link_b])
        own, many = np.unique(doc * len(known) + code, return_counts=True)
        edge = np.searchsorted(own, np.arange(len(rows) + 1) * len(known))
        flat = known[own % len(known)]
        at = 0
        for k, i in enumerate(rows):
            digest[i] = hashlib.sha256(text[at:stops[k]]).hexdigest()
            at = stops[k]
            pairs[i], times[i] = flat[edge[k]:edge[k + 1]], many[edge[k]:edge[k + 1]]
    return out | {"groups_sha256": digest, "pairs": pairs, "times": times}


# --- the Spark side -----------------------------------------------------------------

def _lists(values: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)], dtype=np.int32), np.concatenate([np.empty(0, np.int64), *values]).astype(np.int64))


def pair_totals(docs: DataFrame) -> DataFrame:
    """(pair, n): links of every id pair over all documents; a batch sums before the shuffle."""
    def add(batches):
        for part in batches:
            code, known = pd.factorize(part.column("pairs").flatten().to_numpy())
            n = np.bincount(code, weights=part.column("times").flatten().to_numpy(), minlength=len(known))
            yield pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array(n.astype(np.int64))], names=["pair", "n"])

    return docs.select("pairs", "times").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def alignments(docs: DataFrame, json_path: str, rank_path: str, piece_path: str, keep: tuple[str, ...] = ("doc_id",), share: int = SHARE) -> DataFrame:
    """``keep`` columns and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    checkpoint_root(spark)
    for path in (json_path, rank_path, piece_path):
        spark.sparkContext.addFile(path)
    names = tuple(map(os.path.basename, (json_path, rank_path, piece_path)))
    kinds = dict(docs.dtypes)
    counts = ("n_a", "n_b", "n_groups", "n_links")

    def run(batches):
        known = _tokenizers(names)
        for part in text_slices(batches, "text"):
            found = align(known, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in keep), *(pa.array(found[c], pa.int64()) for c in counts), pa.array(found["groups_sha256"], pa.string()),
                 _lists(found["pairs"]), _lists(found["times"])], names=[*keep, *counts, "groups_sha256", "pairs", "times"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"{c} long" for c in counts), "groups_sha256 string, pairs array<long>, times array<long>"])
    done = stage(docs.select(*keep, "text").mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "aligned")

    totals = stage(pair_totals(done), "pairs")
    peak = totals.groupBy((F.col("pair") % (1 << 32)).alias("b")).agg(F.max("n").alias("most"))
    ranked = stage(totals.join(peak, F.col("pair") % (1 << 32) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "ranked")
    total = ranked.agg(F.sum("n")).first()[0] or 0
    heavy = ranked.where(F.col("n") * share >= total).orderBy("pair").toArrow()  # at most `share` rows
    shared = spark.sparkContext.broadcast(tuple(heavy.column(c).to_numpy() for c in ("pair", "n", "best")))

    def settle(batches):
        pair, n, best = shared.value
        for part in batches:
            lists = part.column("pairs")
            codes, times = lists.flatten().to_numpy(), part.column("times").flatten().to_numpy()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), sizes)
            at = np.minimum(np.searchsorted(pair, codes), max(len(pair) - 1, 0))
            hit = pair[at] == codes if len(pair) else np.zeros(len(codes), bool)
            add = np.zeros((2, part.num_rows), np.int64)
            np.add.at(add[0], row[hit], n[at[hit]] * times[hit])
            np.add.at(add[1], row[hit], best[at[hit]] * times[hit])
            rest = np.cumsum([0, *np.bincount(row[~hit], minlength=part.num_rows)], dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("_row", *keep, *counts, "groups_sha256")), pa.array(add[0]), pa.array(add[1]),
                 pa.ListArray.from_arrays(rest, codes[~hit]), pa.ListArray.from_arrays(rest, times[~hit])],
                names=["_row", *keep, *counts, "groups_sha256", "heavy_sum", "heavy_best", "pairs", "times"])

    settled = stage(done.mapInArrow(settle, f"_row long, {schema.replace('pairs array', 'heavy_sum long, heavy_best long, pairs array')}"), "settled")
    links = settled.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("_row", "p.pairs", "p.times")
    light = ranked.where(F.col("n") * share < total)
    rare = (links.join(light, F.col("pairs") == F.col("pair"))
            .groupBy("_row").agg(F.sum(F.col("n") * F.col("times")).alias("rare_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("rare_best")))
    some = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return (settled.drop("pairs", "times").join(rare, "_row", "left")
            .select(*keep, *counts, (F.col("heavy_best") + some("rare_best")).alias("n_best"), (F.col("heavy_sum") + some("rare_sum")).alias("count_sum"), "groups_sha256"))


@query("op11_alignment")
def op11_alignment(spark, sf_dir):
    import public_tokenizers as known
    return alignments(table(spark, sf_dir, "documents"), *map(known.path, ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model")))
