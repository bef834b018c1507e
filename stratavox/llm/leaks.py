"""Passages of evaluation items in a training corpus (problem 8).

Method, q-gram lemma filtering: a passage of L characters that occurs with at most e edits shares at least L + 1 - q (e + 1) of its
q-grams with the place, all on diagonals that lie within e of each other. Shared q-grams are counted in overlapping bands of
diagonals; what meets the bound is verified by banded alignment.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stash
from .lookalikes import CYRILLIC, GREEK, IGNORABLE, _PerCharacter

WORDS = 13
Q = 12
#: Edits allowed per character of a passage.
EDIT_SHARE = 0.03
#: Characters of evaluation items that are indexed and broadcast at once; more are worked off in blocks, one after another, each against the words of all documents.
BLOCK_CHARS = 3_000_000
#: Characters of documents that are searched at once inside a task; longer documents are searched in overlapping slices.
SLICE_CHARS = 2_000_000
#: Shared q-grams that are held at once; where there are more, documents are searched in fewer or shorter slices.
POSTINGS = 16_000_000

_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_BYTES = bytes(ord(chr(b).lower()) if b < 128 else b for b in _BYTES)


def _plain(ch: str) -> str:
    if any(a <= ord(ch) <= b for a, b in IGNORABLE) or unicodedata.combining(ch) or unicodedata.category(ch) in ("Mn", "Me"):
        return ""
    ch = CYRILLIC.get(ch) or GREEK.get(ch) or ch
    return ch if ch.isalnum() else " "


@cache
def _plain_table() -> _PerCharacter:
    return _PerCharacter(_plain)


def word_text(text: str) -> bytes:
    """The words of a text, one space between them, in UTF-8: runs of letters and digits without case, after look-alike, full-width, combining
    and invisible characters are read as their plain form."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKD", text).translate(_plain_table()).casefold()).translate(_plain_table())
    return b" ".join(text.encode("utf-8", "ignore").translate(_BYTES).split())


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every run of Q = 12 bytes, taken from an 8-byte and a 4-byte window."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    head = np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,))
    tail = np.ndarray((n,), dtype="<u4", buffer=data, offset=8, strides=(1,)).astype(np.uint64)
    out = head * np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(29)
    tail += np.uint64(0x165667B1)
    tail *= np.uint64(0xC2B2AE3D27D4EB4F)
    out ^= tail
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    return out


@dataclass
class ItemIndex:
    """Passages of a block of items and their q-grams."""

    #: nullable integers
    ids: pd.api.extensions.ExtensionArray
    texts: list[bytes]
    #: per passage: item, first and last + 1 character, edits allowed, least number of shared q-grams
    item: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    edits: np.ndarray
    bound: np.ndarray
    #: passages of item i are first[i] … first[i + 1] - 1; least[i] is the smallest bound among them
    first: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    starts: np.ndarray
    gram_item: np.ndarray
    gram_at: np.ndarray
    maybe: np.ndarray


def _whole(ids: list) -> pd.api.extensions.ExtensionArray:
    """Ids, whole numbers or their text, as exact nullable integers."""
    return pd.array([None if pd.isna(i) else int(i) for i in ids], dtype="Int64")


def index_items(items: pd.DataFrame, words: int = WORDS, edit_share: float = EDIT_SHARE) -> ItemIndex:
    """Index of item_id, text. Items with fewer than ``words`` words have no passage. An id may be null, and be written as text."""
    rows = [(i, word_text(t)) for i, t in zip(items["item_id"], items["text"]) if isinstance(t, str)]
    ids, texts, passages, hashes, owner, at = [], [], [], [], [], []
    first = [0]
    for item_id, text in rows:
        cuts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) if text else np.zeros(0, dtype=np.int64)
        begins, ends = np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(text)]])
        if not text or len(begins) < words:
            continue
        me = len(ids)
        ids.append(item_id)
        texts.append(text)
        for b, e in zip(begins[: len(begins) - words + 1], ends[words - 1 :]):
            length = int(e - b)
            allowed = min(int(edit_share * length), (length + 1) // Q - 1)  # the lemma's bound stays at least 1
            passages.append((me, int(b), int(e), max(allowed, 0), max(length + 1 - Q * (max(allowed, 0) + 1), 1)))
        first.append(len(passages))
        h = gram_hashes(np.frombuffer(text, np.uint8))
        hashes.append(h)
        owner.append(np.full(len(h), me))
        at.append(np.arange(len(h)))
    table = np.array(passages, dtype=np.int64).reshape(-1, 5)
    h = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
    order = np.argsort(h, kind="stable")
    grams, starts = np.unique(h[order], return_index=True)
    maybe = np.zeros(1 << 22, dtype=bool)
    maybe[(grams >> np.uint64(42)).astype(np.int64)] = True
    first = np.array(first)
    least = np.minimum.reduceat(table[:, 4], first[:-1]) if len(ids) else np.zeros(0, dtype=np.int64)
    joined = lambda parts: np.concatenate(parts)[order] if parts else np.zeros(0, dtype=np.int64)
    return ItemIndex(_whole(ids), texts, *table.T, first, least, grams, np.append(starts, len(h)), joined(owner), joined(at), maybe)


def _align(patterns: np.ndarray, lengths: np.ndarray, data: np.ndarray, place: np.ndarray, width: int) -> np.ndarray:
    """Least edits between each pattern and a part of ``data`` that begins on one of ``width`` diagonals from ``place`` on (banded alignment)."""
    lane = np.arange(width)
    now = np.zeros((len(lengths), width), dtype=np.int32)
    best = np.full(len(lengths), 1 << 20, dtype=np.int64)
    for i in range(int(lengths.max(initial=0))):
        # the passages come longest first, so those still going are a prefix
        going = int(np.searchsorted(-lengths, -i, side="left"))
        now = now[:going]
        seen = data[np.clip(place[:going, None] + i + lane, 0, len(data) - 1)]
        step = now + (seen != patterns[:going, i, None])
        step[:, :-1] = np.minimum(step[:, :-1], now[:, 1:] + 1)
        now = np.minimum.accumulate(step - lane, axis=1) + lane
        ends = lengths[:going] == i + 1
        best[:going][ends] = now[ends].min(axis=1)
    return best


def _expand(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1 … of each run, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts - starts, counts)


def _slices(text: bytes, size: int, overlap: int) -> Iterator[bytes]:
    """``text`` in slices that overlap, so that any part of up to ``overlap`` characters lies whole in one of them. A slice that begins or ends within a
    word has a mark there, which keeps the rest of the word from being read as a word."""
    if len(text) <= size + overlap:
        yield text
        return
    whole = lambda k: k <= 0 or k >= len(text) or text[k - 1] == 32 or text[k] == 32
    for begin in range(0, len(text) - overlap, size):
        end = min(begin + size + overlap, len(text))
        yield (b"" if whole(begin) else b"\1") + text[begin:end] + (b"" if whole(end) else b"\1")


def search(texts: list[bytes], index: ItemIndex, slice_chars: int = SLICE_CHARS) -> pd.DataFrame:
    """doc (position in ``texts``), item_id, n_passages, least_edits, n_exact for documents that hold passages of items."""
    names = ["doc", "item_id", "n_passages", "least_edits", "n_exact"]
    if not len(index.ids) or not texts:
        return pd.DataFrame({n: np.zeros(0, dtype=np.int64) for n in names})
    overlap = int((index.end - index.begin).max()) + 2 * int(index.edits.max()) + 1
    found, docs, held, chars = [], [], [], 0
    for doc, text in enumerate(texts):
        for piece in _slices(text, slice_chars, overlap):
            docs.append(doc)
            held.append(piece)
            chars += len(piece)
            if chars >= slice_chars:
                found.append(_in_parts(held, np.array(docs), index, overlap))
                docs, held, chars = [], [], 0
    found.append(_in_parts(held, np.array(docs, dtype=np.int64), index, overlap))
    # what two slices of a document share counts once
    rows = pd.concat(found).groupby(["doc", "passage"], as_index=False).agg(edits=("edits", "min"), exact=("exact", "max"))
    rows = rows.assign(item=index.item[rows["passage"].to_numpy(dtype=np.int64)]).groupby(["doc", "item"], as_index=False).agg(n_passages=("passage", "size"), least_edits=("edits", "min"), n_exact=("exact", "sum"))
    return rows.assign(item_id=index.ids[rows["item"].to_numpy(dtype=np.int64)])[names]


_NOTHING = pd.DataFrame({n: np.zeros(0, dtype=np.int64) for n in ("doc", "passage", "edits", "exact")})


def _in_parts(texts: list[bytes], docs: np.ndarray, index: ItemIndex, overlap: int) -> pd.DataFrame:
    """doc, passage, edits, exact of all ``texts``, which are parts of ``docs``; searched in parts where they share many q-grams with the items."""
    found = _passages(texts, index)
    if found is not None:
        return found.assign(doc=docs[found["doc"].to_numpy(dtype=np.int64)])
    if len(texts) > 1:
        half = len(texts) // 2
        parts = [(texts[:half], docs[:half]), (texts[half:], docs[half:])]
    elif len(texts[0]) > 4 * (overlap + 2):
        parts = [([piece], docs) for piece in _slices(texts[0], len(texts[0]) // 2, overlap)]
    else:  # shorter slices would share about as much
        return _passages(texts, index, None).assign(doc=docs[0])
    return pd.concat([_in_parts(t, d, index, overlap) for t, d in parts])


def _passages(texts: list[bytes], index: ItemIndex, postings: int | None = POSTINGS) -> pd.DataFrame | None:
    """doc (position in ``texts``), passage, edits, exact (whether it stands there word for word); None where more than ``postings`` q-grams are shared."""
    none = _NOTHING
    if not texts:
        return none
    gap = b"\0" * Q
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    begins = Q + np.concatenate([[0], np.cumsum([len(t) + Q for t in texts])[:-1]])
    h = gram_hashes(data)
    pos = np.flatnonzero(index.maybe[(h >> np.uint64(42)).astype(np.int64)])
    h = h[pos]
    gram = np.minimum(np.searchsorted(index.grams, h), len(index.grams) - 1)
    met = index.grams[gram] == h
    pos, gram = pos[met], gram[met]
    counts = index.starts[gram + 1] - index.starts[gram]
    if postings is not None and counts.sum() > postings:
        return None
    posting = _expand(index.starts[gram], counts)
    at = np.repeat(pos, counts)
    item, item_at = index.gram_item[posting], index.gram_at[posting]
    doc = np.searchsorted(begins, at, side="right") - 1
    # a document with fewer shared q-grams than an item's least bound has no passage of it
    pair = doc * len(index.ids) + item
    unique, back, shared = np.unique(pair, return_inverse=True, return_counts=True)
    enough = (shared >= index.least[unique % len(index.ids)])[back]
    at, pair, item_at = at[enough], pair[enough], item_at[enough]
    if not len(at):
        return none
    step = int(index.edits.max(initial=0)) + 1
    diagonal = at - item_at
    band = np.floor_divide(diagonal, step)
    # bands are two steps wide and overlap by one, so diagonals within the allowed edits share a band
    pair, band, item_at = np.concatenate([pair, pair]), np.concatenate([band, band - 1]), np.concatenate([item_at, item_at])
    order = np.lexsort((item_at, band, pair))
    pair, band, item_at = pair[order], band[order], item_at[order]
    fresh = np.ones(len(pair), dtype=bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (band[1:] != band[:-1]) | (item_at[1:] != item_at[:-1])
    pair, band, item_at = pair[fresh], band[fresh], item_at[fresh]
    heads = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (band[1:] != band[:-1])]))
    sizes = np.diff(np.append(heads, len(pair)))
    of_item = pair[heads] % len(index.ids)
    kept = sizes >= index.least[of_item]
    heads, sizes, of_item = heads[kept], sizes[kept], of_item[kept]
    if not len(heads):
        return none
    # per region and passage: q-grams of the passage that the band holds
    per = index.first[of_item + 1] - index.first[of_item]
    passage = _expand(index.first[of_item], per)
    region = np.repeat(np.arange(len(heads)), per)
    flat = np.repeat(np.arange(len(heads)), sizes) * (1 << 32) + item_at[_expand(heads, sizes)]
    upto = lambda x: np.searchsorted(flat, region * (1 << 32) + x, side="left")
    held = upto(index.end[passage] - Q + 1) - upto(index.begin[passage])
    kept = held >= index.bound[passage]
    passage, region = passage[kept], region[kept]
    if not len(passage):
        return none
    lengths = (index.end - index.begin)[passage]
    order = np.argsort(-lengths, kind="stable")
    found = []
    for part in np.array_split(order, max(1, len(order) // 20_000)):
        p, r, size = passage[part], region[part], lengths[part]
        patterns = np.zeros((len(p), int(size.max())), dtype=np.uint8)
        for k, x in enumerate(p):
            patterns[k, : size[k]] = np.frombuffer(index.texts[index.item[x]], np.uint8)[index.begin[x] : index.end[x]]
        place = band[heads[r]] * step + index.begin[p]
        edits = _align(patterns, size, data, place, 2 * step)
        good = edits <= index.edits[p]
        found.append(np.column_stack([pair[heads[r]], p, edits])[good])
    rows = pd.DataFrame(np.concatenate(found), columns=["pair", "passage", "edits"]).groupby(["pair", "passage"], as_index=False)["edits"].min()
    exact = np.zeros(len(rows), dtype=np.int64)
    for k in np.flatnonzero(rows["edits"].to_numpy() == 0):
        x = int(rows["passage"].iat[k])
        text = index.texts[index.item[x]][index.begin[x] : index.end[x]]
        exact[k] = b" " + text + b" " in b" " + texts[int(rows["pair"].iat[k]) // len(index.ids)] + b" "
    return pd.DataFrame({"doc": rows["pair"] // len(index.ids), "passage": rows["passage"], "edits": rows["edits"], "exact": exact})


def leaked_passages(docs: DataFrame, items: DataFrame, words: int = WORDS, edit_share: float = EDIT_SHARE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents (doc_id, text) that hold passages of items (item_id, text): item_id, doc_id, n_passages, least_edits, n_exact.

    A passage is any ``words`` consecutive words of an item; it is held where a part of the document's words equals it but for
    edit_share * its length edits. n_passages counts the item's passages held, n_exact those held word for word.
    Items with fewer words, and null texts, take part in nothing. Repeated items or documents give a row each. A null item_id or doc_id
    stays null in the result: what such an item or document shares is reported as that of any other.

    Documents are not shuffled. Items are indexed in tasks, in blocks of bounded size. One block is broadcast and the documents are scanned once. If
    there are more, the documents' words are written once, and the blocks are broadcast one after another, each dropped when its results are written.
    """
    spark = docs.sparkSession
    texts = items.filter("text is not null").select(_as_text("item_id"), "text")
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_chars))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "data": [pickle.dumps(index_items(pdf, words, edit_share))]})

    dealt = texts.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).cast("int"))
    indexed = Stash(dealt.groupBy("block").applyInPandas(build, "block int, data binary"), "items")
    read = docs.filter("text is not null").select(_as_text("doc_id"), "text")
    if blocks > 1:
        read = Stash(read.mapInPandas(_words, "doc_id string, text binary"), "words").df
    shape = "item_id long, doc_id long, n_passages int, least_edits int, n_exact int"
    parts = []
    for block in range(blocks):
        data = indexed.df.filter(F.col("block") == block).select("data").first()
        if data is None:
            continue
        held = spark.sparkContext.broadcast(pickle.loads(data[0]))  # our own index, of bounded size
        part = read.mapInPandas(_scan(held), shape)
        if blocks > 1:
            part = Stash(part, "leaks").df
            held.unpersist(blocking=False)
        parts.append(part)
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], shape)


def _words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(text=[word_text(t) for t in pdf["text"]])


def _scan(held):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = held.value
        for pdf in batches:
            texts = [t if isinstance(t, bytes) else word_text(t) for t in pdf["text"]]
            found = search(texts, index)
            found["doc_id"] = _whole(pdf["doc_id"].iloc[found["doc"].to_numpy(dtype=np.int64)].tolist())
            yield found[["item_id", "doc_id", "n_passages", "least_edits", "n_exact"]]

    return scan


def _as_text(name: str) -> Column:
    """An id as text, since a null among integers makes pandas read a batch's ids as floats, which lose digits beyond 2^53."""
    return F.col(name).cast("long").cast("string").alias(name)
