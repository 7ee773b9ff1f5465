"""Best-fit packing with certified bounds.

Texts become token ids; documents longer than a sequence are cut into pieces, nothing else is. Pieces that fill a sequence
stand alone. The others are dealt by row over partitions of about ``ITEMS`` pieces and packed there best-fit decreasing.
Dual-feasible functions (the identity, the threshold family of Martello and Toth, the rounding family of Fekete and
Schepers) bound each partition's number of sequences from below. A partition that meets its bound is certified: it keeps
its sequences but for the emptiest, whose pieces are exchanged. A partition with a gap keeps its full sequences and
exchanges all other pieces. What is exchanged is dealt anew over fewer partitions and packed again, until one partition
holds it all or a round sheds less than a tenth of it; what is left then is packed once more and may keep a gap.

Null and empty texts are documents of one token, the closing id. Rows that repeat are packed each. An empty table gives an
empty result. Columns other than doc_id and text are not read. A group in a task never holds more than a few times
``ITEMS`` pieces, since pieces are dealt by the hash of a number of their own.
"""
from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import small_batches, stored

CAPACITY = 4096
END_ID = 1
ITEMS = 20_000
#: Entries of a worker's cache of encoded words; beyond it, it starts anew. No effect on results.
CACHE = 600_000
#: Bytes of text that are encoded at once, about.
SLICE = 1 << 22

#: A normaliser and a first splitting rule that never join what stands on two sides of a blank or a line feed.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Latin letters that lower-casing and composing leave letters, one for one.
LATIN = "a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: The byte-level alphabet: bytes that print stand for themselves, the others for what follows U+0100.
_PRINT = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b for b in _PRINT} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINT)}

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_WORD = re.compile(f"[{LATIN}]+")
_encoders: dict[int, "WordEncoder"] = {}


def splits_at_blanks(spec: str) -> bool:
    """If a tokenizer (its JSON) has the normaliser and the splitting rule by which words may be encoded one by one."""
    parts = json.loads(spec)
    first, *then = (parts.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return [x.get("type") for x in then] == ["ByteLevel"] and (parts.get("normalizer") or {}).get("normalizers") == NORMALISERS and first.get("pattern") == {"Regex": SPLIT} and first.get("invert") is True


class WordEncoder:
    """Ids of texts. Where the tokenizer never joins across a blank or a line feed, the distinct words of a batch are looked up in
    a table of known words and texts are put together by offsets; a text in which a special token may occur, and every text of
    another tokenizer, is encoded as a whole.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.by_word = splits_at_blanks(spec)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {"": 0}
        self.ids, self.first, self.many = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text (none is null)."""
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        rest = np.flatnonzero(~special)
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for i in np.flatnonzero(special):
            out[i] = self.whole(texts[int(i)].as_py())
        if len(rest):
            for i, x in zip(rest.tolist(), self._by_word(texts.take(pa.array(rest)) if len(rest) < len(texts) else texts)):
                out[i] = x
        return out

    def _by_word(self, texts: pa.Array) -> list[np.ndarray]:
        # a full stop or comma between a letter and a blank is a token run of its own
        apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), f"([{LATIN}])([.,])( |$)", r"\1 \2 ")
        split = pc.split_pattern(apart, " ")
        ends = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        at = self.places(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        many = self.many[at]
        sums = np.concatenate([[0], np.cumsum(many)])
        ids = self.ids[np.repeat(self.first[at] - sums[:-1], many) + np.arange(sums[-1])]
        return np.split(ids, sums[ends[1:-1]])

    def places(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the table; new ones are encoded first."""
        if len(self.known) > CACHE:
            self._forget()
        known = self.known
        missing = [w for w in words if w not in known]
        if missing:
            ids = self._ids(missing)
            sizes = np.fromiter(map(len, ids.values()), np.int64, len(ids))
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(sizes) - sizes])
            self.many = np.concatenate([self.many, sizes])
            self.ids = np.concatenate([self.ids, np.fromiter((t for x in ids.values() for t in x), np.uint32, int(sizes.sum()))])
            known.update(zip(ids, range(len(known), len(known) + len(ids))))
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _ids(self, words: list[str]) -> dict[str, list[int]]:
        model, out = self.tokenizer.model, {}
        for w in words:
            if w.isascii() and w.isalpha():  # nothing to split or normalise but case
                out[w] = [t.id for t in model.tokenize(w.lower())]
            elif _WORD.fullmatch(w):
                out[w] = [t.id for t in model.tokenize(w.lower().encode().decode("latin-1").translate(BYTES))]
        rest = [w for w in words if w not in out]
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            out.update((w, e.ids) for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)))
        return out


def _encoder(spec: str) -> WordEncoder:
    key = hash(spec)
    if key not in _encoders:
        _encoders[key] = WordEncoder(spec)
    return _encoders[key]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece of every document."""
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), "")
            load = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE
            cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(ids)]
            for at, end_at in zip(cuts, cuts[1:]):
                rows: list[tuple] = []
                for doc_id, found in zip(ids[at:end_at], encoder.encode(texts.slice(at, end_at - at))):
                    data = found.astype("<u4", copy=False).tobytes() + end
                    for k, start in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[start : start + 4 * capacity]
                        rows.append((doc_id, k, start // 4, len(part) // 4, zlib.crc32(part)))
                if not rows:
                    continue
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound of the dual-feasible functions, from the counts of each length."""
    if not len(lengths):
        return 0
    n = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    up, mass = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(mass[-1]) // capacity)
    eps = np.arange(1, capacity // 2 + 1)
    above = up[-1] - up[capacity - eps]  # longer than capacity - eps: one each
    middle = mass[capacity - eps] - mass[eps - 1]
    best = max(best, int((above - (-middle // capacity)).max(initial=0)))
    for k in range(1, 8):
        scaled = size * (k + 1)
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int((value * n).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each length. A bit for each residual capacity that some bin has."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    open_at: dict[int, list[int]] = {}
    mask, used = 0, 0
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        fits = mask >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            stack = open_at[room]
            b = stack.pop()
            if not stack:
                mask ^= 1 << room
        else:
            b, room, used = used, capacity, used + 1
        bins[i], offsets[i] = b, capacity - room
        left = room - need
        stack = open_at.setdefault(left, [])
        if not stack:
            mask |= 1 << left
        stack.append(b)
    return bins, offsets


def _filler(turn: int, last: bool, capacity: int):
    """Packs one partition's rows and says which sequences stay."""

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        lengths = rows["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        load = np.bincount(bins, weights=lengths).astype(np.int64)
        if last:
            keep = np.ones(len(load), bool)
        elif len(load) == lower_bound(lengths, capacity):
            keep = np.arange(len(load)) != load.argmin()
        else:
            keep = load == capacity
        base = (turn << 56) + (int(rows["_part"].iloc[0]) << 24)
        return rows.assign(sequence_id=bins + base, offset=offsets, _keep=keep[bins])

    return fill


def pack(pieces_df: DataFrame, capacity: int = CAPACITY, items: int = ITEMS) -> DataFrame:
    """The pieces with sequence_id and offset; any further columns are carried along."""
    columns = [c for c in pieces_df.columns if c not in ("sequence_id", "offset")]
    pool = stored(pieces_df.select(*columns).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = pool.where(F.col("length") >= capacity)
    done = [whole.withColumn("sequence_id", F.col("_row") + F.lit(1 << 60)).withColumn("offset", F.lit(0).cast("long"))]
    pool = pool.where(F.col("length") < capacity)
    left, before, turn = pool.count(), None, 0
    while left:
        parts = -(-left // items) if turn else max(16, -(-left // items))
        last = parts == 1 or (before is not None and 10 * left > 9 * before)
        dealt = pool.withColumn("_part", F.pmod(F.xxhash64("_row", F.lit(turn)), F.lit(parts)).cast("int"))
        schema = StructType(list(dealt.schema.fields)).add("sequence_id", "long").add("offset", "long").add("_keep", "boolean")
        packed = stored(dealt.groupBy("_part").applyInPandas(_filler(turn, last, capacity), schema), f"packed{turn}")
        done.append(packed.where("_keep").drop("_part", "_keep"))
        pool = packed.where("not _keep").drop("_part", "_keep", "sequence_id", "offset")
        before, left, turn = left, 0 if last else pool.count(), turn + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select(*columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    return pack(pieces(docs, tokenizer_path, capacity), capacity)
