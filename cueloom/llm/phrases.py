"""Passages that repeat across documents, located by Aho-Corasick automata and removed.

A window is a run of 13 consecutive words. A word goes if some window over it
also starts in a document with a smaller id. Work passes through four steps:

1. The least hash of the nine 5-word runs inside a window is its key, so equal
   windows have equal keys and a key serves several windows in a row. Keys of two documents or more are marked in a bitmap of fixed size.
2. Windows with a marked key are grouped by their own hashes (96 bits); those
   that a later document holds too are the recurring passages, and the first document of each is kept.
3. Documents are dealt into groups of a few megabytes. Each group gets the
   pieces of earlier documents that hold the windows found in it, each piece once.
4. Each group is a shard: its pieces are cut into tiles of seven words, of
   which any 13 words hold a whole one, and compiled into one automaton. All
   documents of the group stream through it; where a tile is found, the match
   is extended word by word, so what is removed is equal in fact, not by its hash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .bits import bitmap, is_set
from .near_dup import bounded_batches
from .scratch import Scratch

#: Words of the runs whose least hash is a window's key.
RUN = 5
#: First words of a piece: it holds the windows that start at these.
PIECE = 64
#: Bytes of text of a group of documents.
GROUP = 4 << 20


def _windows(data, offsets, width: int):
    """Of a block of texts: keys, window hashes, second hashes, rows and positions in their rows of all windows; byte ranges and bounds of the words."""
    import numpy as np

    h, bounds, starts, ends = textvec.words(data, offsets, fold=False)
    many = np.maximum(np.diff(bounds) - width + 1, 0)
    row = np.repeat(np.arange(len(many)), many)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    if not len(row):
        none = np.zeros(0, np.uint64)
        return none, none, none, row, pos, bounds, starts, ends
    a, c = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA24BAED4963EE407)
    two = textvec.mix(h[:-1] * a + h[1:])
    four = textvec.mix(two[:-2] * c + two[2:])
    run = textvec.mix(four[:-1] * a + h[RUN - 1 :])
    least, span = run, 1
    while span < width - RUN + 1:
        step = min(span, width - RUN + 1 - span)
        least = np.minimum(least[:-step], least[step:])
        span += step
    at = bounds[:-1][row] + pos
    whole, other, shift = run[at], run[at], 0
    while shift < width - RUN:
        shift = min(shift + RUN - 1, width - RUN)
        whole = textvec.mix(whole * a + run[at + shift])
        other = textvec.mix(other * c ^ run[at + shift])
    return least[at], whole, other, row, pos, bounds, starts, ends


def window_keys(docs: DataFrame, width: int) -> DataFrame:
    """(key, doc_id) of the windows of ``docs(doc_id, text)``, once for windows in a row."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(1))
            for i, j in textvec.blocks(offsets):
                key, _, _, row, *_ = _windows(data, offsets[i : j + 1], width)
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), batch.column(0).take(pa.array(i + row[new]))], names=["key", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(work, "key long, doc_id long")


def candidates(docs: DataFrame, marked, width: int) -> DataFrame:
    """Of each of ``docs(doc_id, shard, text)``, the windows with a marked key (hash, second hash, position) and the pieces of text that hold them."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        bits = marked.value

        def lists(values, counts):
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)

        for batch in batches:
            data, offsets = textvec.string_buffers(batch.column(2))
            for i, j in textvec.blocks(offsets):
                key, whole, other, row, pos, bounds, starts, ends = _windows(data, offsets[i : j + 1], width)
                hit = np.flatnonzero(is_set(bits, key.view(np.int64)))
                if not len(hit):
                    continue
                whole, other, row, pos = whole[hit], other[hit], row[hit], pos[hit]
                held, counts = np.unique(row, return_counts=True)
                piece = pos // PIECE
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
                row_p, piece = row[new], piece[new]
                first = bounds[:-1][row_p] + piece * PIECE
                last = np.minimum(first + PIECE + width - 1, bounds[1:][row_p]) - 1
                texts = pa.array([data[a:b].tobytes() for a, b in zip(starts[first], ends[last])], pa.binary())
                n_pieces = np.bincount(row_p, minlength=j - i)[held]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(i + held)), batch.column(1).take(pa.array(i + held)),
                        lists(pa.array(whole.view(np.int64)), counts), lists(pa.array(other.view(np.int64).astype(np.int32)), counts), lists(pa.array(pos.astype(np.int32)), counts),
                        lists(pa.array(piece.astype(np.int32)), n_pieces), lists(texts, n_pieces),
                    ],
                    names=["doc_id", "shard", "whole", "other", "pos", "piece", "piece_text"],
                )

    out = "doc_id long, shard int, whole array<long>, other array<int>, pos array<int>, piece array<int>, piece_text array<binary>"
    return docs.select("doc_id", "shard", "text").mapInArrow(work, out)


#: Letters of a word's code.
LETTERS = 64


def _codes(words) -> dict:
    """A code for each word: letters of one alphabet a place, so codes in a row match at their bounds only.

    An automaton looks through the letters that may follow, so it is fast over few letters and slow over all words.
    """
    width = 1
    while LETTERS**width < len(words):
        width += 1
    alphabets = [[chr(256 + LETTERS * place + i) for i in range(LETTERS)] for place in range(width)]
    codes = ("".join(letters) for letters in itertools.product(*alphabets))
    return dict(zip(words, codes)) | {None: chr(1) * width}


def _extend(words: list, at: int, piece: list, off: int, tile: int) -> tuple[int, int]:
    """The longest equal stretch around words[at : at + tile] = piece[off : off + tile]."""
    a, b = at, at + tile
    i, j = off, off + tile
    while a > 0 and i > 0 and words[a - 1] == piece[i - 1]:
        a, i = a - 1, i - 1
    stop = min(len(words), b + len(piece) - j)
    while b < stop and words[b] == piece[j]:
        b, j = b + 1, j + 1
    return a, b


def _repeated(words: list, doc_id: int, shard: dict, width: int, tile: int) -> bytearray:
    """1 for each word that a stretch of ``width`` words or more of a piece of an earlier document covers."""
    gone = bytearray(len(words))
    code, none = shard["codes"].get, shard["codes"][None]
    letters = len(none)
    for last, k in shard["automaton"].iter("".join([code(w, none) for w in words])):
        end = last // letters
        at = end - tile + 1
        lo, hi = max(0, at - (width - tile)), min(len(words), end + 1 + width - tile)
        if gone.count(1, lo, hi) == hi - lo:
            continue
        for source, piece, off in shard["tiles"][k]:
            if source < doc_id:
                a, b = _extend(words, at, piece, off, tile)
                if b - a >= width:
                    gone[a:b] = b"\x01" * (b - a)
    return gone


def _compiled(pieces: list, tile: int) -> dict | None:
    """The automaton over the tiles of (doc_id, text) pieces, in codes of their words."""
    import ahocorasick

    split = [(source, text.split()) for source, text in pieces]
    codes = _codes({w for _, words in split for w in words})
    places, tiles, automaton = {}, [], ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for source, words in split:
        for off in range(0, len(words) - tile + 1, tile):
            key = "".join([codes[w] for w in words[off : off + tile]])
            if key not in places:
                places[key] = len(tiles)
                tiles.append([])
                automaton.add_word(key, places[key])
            tiles[places[key]].append((source, words, off))
    if not tiles:
        return None
    automaton.make_automaton()
    return {"codes": codes, "tiles": tiles, "automaton": automaton}


def stream_shards(rows: DataFrame, width: int) -> DataFrame:
    """Streams ``rows(shard, doc, doc_id, text)``, sorted by (shard, doc): the pieces of a shard come first (doc false), then its documents."""
    tile = (width + 1) // 2

    def work(batches):
        import numpy as np
        import pyarrow as pa

        now, pieces, shard = None, [], None
        for batch in batches:
            out = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "starts", "stops")}
            for g, doc, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if g != now:
                    now, pieces, shard = g, [], None
                if not doc:
                    pieces.append((doc_id, text))
                    continue
                if pieces:
                    shard, pieces = _compiled(pieces, tile), []
                words = (text or b"").split()
                gone = _repeated(words, doc_id, shard, width, tile) if shard and doc_id is not None and len(words) >= width else b""
                edges = np.flatnonzero(np.diff(np.frombuffer(b"\x00" + gone + b"\x00", np.uint8).astype(np.int8)))
                kept = [w for w, x in zip(words, gone) if not x] if len(edges) else words
                for k, v in zip(out, (doc_id, len(words), len(words) - len(kept), b" ".join(kept), edges[::2], edges[1::2])):
                    out[k].append(v)
            ends = np.cumsum([0, *map(len, out["starts"])]).astype(np.int32)
            flat = [np.concatenate([np.zeros(0, np.int64), *out[k]]).astype(np.int32) for k in ("starts", "stops")]
            spans = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(x) for x in flat], names=["start", "stop"]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["doc_id"], pa.int64()), pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), spans, pa.array(out["kept"], pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text"],
            )

    return rows.select("shard", "doc", "doc_id", "text").mapInArrow(work, "doc_id long, n_words long, n_removed long, removed array<struct<start int, stop int>>, kept_text string")


def remove_repeats(docs: DataFrame, width: int = 13, group_bytes: int = GROUP) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` without the words that repeat an earlier document.

    Returns doc_id, n_words, n_removed, removed (word ranges, the end
    exclusive) and kept_text (the kept words joined by one space). Words are
    runs outside 0x20 and 0x09-0x0D, unchanged. A word is removed if a window of
    ``width`` words over it also starts in a document with a smaller doc_id;
    windows are judged on the input. So of passages that repeat, the one with
    the smallest id stays, repeats inside one document stay, and rows of one
    doc_id don't remove each other's words.

    Null or empty text: no words. A row without doc_id keeps all its words and
    removes none. Other columns are ignored. No rows give no rows. ``width`` must be 8 or more.
    """
    if width < 8:
        raise ValueError("width must be 8 words or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "phrases")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = 1 + (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes
    docs = docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int"))
    known = docs.where("doc_id is not null")

    keys = window_keys(known, width).groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("key")
    marked = bitmap(keys)
    found = scratch.cut(candidates(known, marked, width), "candidates", "zstd")
    marked.unpersist()
    windows = found.select("doc_id", "shard", F.inline(F.arrays_zip("whole", "other", "pos")))
    first = windows.groupBy("whole", "other").agg(F.min("doc_id").alias("source"), F.min_by("pos", "doc_id").alias("at"))
    first = scratch.cut(first.select("whole", "other", "source", F.expr(f"at div {PIECE}").cast("int").alias("piece")), "first", "zstd")
    wanted = windows.select("whole", "other", "doc_id", "shard").join(first.hint("shuffle_hash"), ["whole", "other"]).where("source < doc_id")
    wanted = scratch.cut(wanted.select("shard", "source", "piece").distinct(), "wanted")
    scratch.delete(scratch.last["first"])
    pieces = found.select(F.col("doc_id").alias("source"), F.inline(F.arrays_zip("piece", "piece_text")))
    pieces = pieces.join(wanted, ["source", "piece"]).select("shard", F.lit(False).alias("doc"), F.col("source").alias("doc_id"), F.col("piece_text").alias("text"))
    rows = docs.select("shard", F.lit(True).alias("doc"), "doc_id", F.col("text").cast("binary").alias("text")).unionByName(pieces)
    return stream_shards(rows.repartition("shard").sortWithinPartitions("shard", "doc"), width)
