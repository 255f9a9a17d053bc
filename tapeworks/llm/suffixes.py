"""Suffix-array dedup: take out the bytes of passages that an earlier document holds too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import as_id, binary_text, blocks, id_or_none, table, whole_text
from .lyndon import suffix_array
from .passages import decide, full

LENGTH = 50
ANCHOR = 16  # bytes of an anchor; each passage of LENGTH bytes has exactly one
SPAN = LENGTH - ANCHOR  # how far an anchor may stand from its passage's start
BUCKET_BYTES = 6 << 20  # of text whose anchors share a bucket, and a task's text before it hands on anchors
BLOCK = 2048  # contexts of one block
CROWD = 2048  # an anchor with more contexts than this is split by the bytes next to it
_NONE = np.iinfo(np.int64).max
_SLICE = 1 << 19
_CALL = 2 << 20  # bytes of segments that look for their anchors together
_PLACE = np.uint64((1 << 24) - 1)
_FIELDS = (("id", 8, 0), ("anchor", 4, 32), ("context", 6, 16), ("tag", 2, 0), ("pos", 4, 0))  # name, bytes, bits cut


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(256, dtype=np.uint64) + np.uint64(1), 1)
_BASE = 0xD6E8FEB86659FD93


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number."""
    words = np.empty(len(raw) - 7, dtype="<u8")
    for i in range(8):
        part = (len(raw) - i) // 8
        words[i::8] = raw[i : i + part * 8].view("<u8")
    return words


def anchors(segments: list[tuple[bytes, int, int]]) -> tuple[np.ndarray, ...]:
    """Segment, place in it, anchor hash and context hash of the anchors of passages that start where a segment says.

    A segment is bytes and the first and last start of its passages. A passage's anchor is the gram in it with the least
    hash, the rightmost of equals: equal passages have equal anchors at equal distance. A context is all that an anchor's
    passages can cover, cut off at the segment's ends; its hash also tells where it is cut. Places are packed beside the
    hashes, so all segments of a call together must stay within what _PLACE can hold.
    """
    raw = np.frombuffer(b"\xff".join(s for s, _, _ in segments) + b"\xff" * LENGTH, np.uint8)
    if len(raw) > _PLACE:
        raise ValueError(f"{len(raw)} bytes of segments in one call, {_PLACE} at most")
    sizes = np.array([len(s) for s, _, _ in segments], dtype=np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    words = _words(raw)
    hashes = _mix(words[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ _mix(words[8:], 7), 11)
    least = (hashes & ~_PLACE) | (_PLACE - np.arange(len(hashes), dtype=np.uint64))
    size = 1
    while size <= SPAN:
        step = min(size, SPAN + 1 - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    steps = np.zeros(len(raw) + 1, dtype=np.int64)
    for begin, (_, first, last) in zip(begins, segments):
        if last >= first:
            steps[begin + first] += 1
            steps[begin + last + 1] -= 1
    starts = np.flatnonzero(np.cumsum(steps)[: len(least)])
    at = np.unique((_PLACE - (least[starts] & _PLACE)).astype(np.int64))
    segment = np.searchsorted(begins, at, side="right") - 1
    low = np.maximum(at - SPAN, begins[segment])
    high = np.minimum(at + LENGTH, begins[segment] + sizes[segment])
    forward = np.cumprod(np.full(len(raw), _BASE, dtype=np.uint64), dtype=np.uint64)
    back = np.cumprod(np.full(len(raw), pow(_BASE, -1, 1 << 64), dtype=np.uint64), dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LETTER[raw] * forward, dtype=np.uint64)))
    cut = _mix(((at - low) * 256 + (high - at)).astype(np.uint64), 3)
    return segment, at - begins[segment], hashes[at], _mix((sums[high] - sums[low]) * back[low] ^ cut, 5)


def _segments(text: bytes) -> Iterator[tuple[int, tuple[bytes, int, int]]]:
    """A text's offset and segment, cut with a margin where it is long."""
    margin, last = 2 * LENGTH, len(text) - LENGTH
    for start in range(0, max(1, last + 1), _SLICE):
        low = max(0, start - margin)
        yield low, (text[low : start + _SLICE + margin], start - low, min(last, start + _SLICE - 1) - low)


def _calls(segments: list[tuple[bytes, int, int]]) -> Iterator[slice]:
    """Runs of segments of about _CALL bytes, one at least."""
    ends = np.cumsum([len(s) for s, _, _ in segments])
    start = 0
    while start < len(segments):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + _CALL, side="right")))
        yield slice(start, stop)
        start = stop


def _packed(columns: dict[str, np.ndarray]) -> bytes:
    """Columns of whole numbers by byte plane, so that their empty high bytes lie together."""
    return b"".join(
        np.ascontiguousarray((columns[name].astype(np.uint64) >> np.uint64(cut)).view(np.uint8).reshape(-1, 8).T[:width]).tobytes()
        for name, width, cut in _FIELDS
    )


def _unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    total, parts = sum(w for _, w, _ in _FIELDS), {name: [] for name, _, _ in _FIELDS}
    for blob in blobs:
        planes, at = np.frombuffer(blob, np.uint8).reshape(total, -1), 0
        for name, width, _ in _FIELDS:
            wide = np.zeros((planes.shape[1], 8), dtype=np.uint8)
            wide[:, :width] = planes[at : at + width].T
            parts[name].append(wide.view("<u8").ravel())
            at += width
    return {name: np.concatenate(p) for name, p in parts.items()}


def _collect_anchors(buckets: int):
    """(bucket, blob): the anchors of a task's texts, equal texts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            columns = dict(zip((n for n, _, _ in _FIELDS), (np.concatenate(c) for c in zip(*held))))
            bucket = (columns["anchor"] % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, first = np.unique(bucket[order], return_index=True)
            blobs = [_packed({n: c[part] for n, c in columns.items()}) for part in np.split(order, first[1:])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for batch in blocks(batches, 2, 1 << 19):
            segments, ids, tags, offsets = [], [], [], []
            for doc, tag, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                name = xxhash.xxh3_128_intdigest(text)
                if len(text) < LENGTH or seen.get(name, doc + 1) <= doc:
                    continue
                seen[name] = doc
                for offset, segment in _segments(text):
                    segments.append(segment)
                    ids.append(doc)
                    tags.append(tag)
                    offsets.append(offset)
            for part in _calls(segments):
                owner, place, anchor, context = anchors(segments[part])
                held.append((np.array(ids[part])[owner], anchor, context, np.array(tags[part])[owner], np.array(offsets[part])[owner] + place))
                size += sum(len(s) for s, _, _ in segments[part])
                if size > BUCKET_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _shared_anchors(group: pa.Table) -> pa.Table:
    """The rows of one bucket whose anchor more than one document holds, by what they need.

    ``kind`` 0: an earlier document has the same context, so every passage around the anchor goes. 1: the row is the first of
    its context, and there are others to compare it with. 2: the same, with more than CROWD contexts.
    """
    rows = _unpacked(group["blob"].to_pylist())
    ids = rows["id"].view(np.int64)
    order = np.lexsort((rows["pos"], rows["tag"], ids, rows["context"], rows["anchor"]))
    rows, ids = {n: c[order] for n, c in rows.items()}, ids[order]
    new_anchor = np.concatenate(([True], rows["anchor"][1:] != rows["anchor"][:-1]))
    new_context = new_anchor | np.concatenate(([True], rows["context"][1:] != rows["context"][:-1]))
    again = np.concatenate(([False], (ids[1:] == ids[:-1]) & (rows["tag"][1:] == rows["tag"][:-1]) & (rows["pos"][1:] == rows["pos"][:-1]))) & ~new_context
    starts = np.flatnonzero(new_anchor)
    of_anchor, of_context = np.cumsum(new_anchor) - 1, np.cumsum(new_context) - 1
    contexts = np.add.reduceat(new_context.astype(np.int32), starts)[of_anchor]
    documents = (np.maximum.reduceat(ids, starts) != np.minimum.reduceat(ids, starts))[of_anchor]
    later = ids > ids[np.flatnonzero(new_context)][of_context]
    kind = np.where(later, 0, np.where(contexts > CROWD, 2, 1)).astype(np.int8)
    stay = np.flatnonzero((later | (contexts > 1) & documents) & ~again)
    pick = lambda c: pa.array(c[stay])
    name = np.where(kind == 0, 0, rows["anchor"] & np.uint64(2**31 - 1)).astype(np.int32)
    return pa.table({"_id": pick(ids), "tag": pick(rows["tag"].astype(np.int32)), "pos": pick(rows["pos"].astype(np.int64)), "kind": pick(kind), "name": pick(name)})


def _rows_of_bytes(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte strings as rows of a matrix, filled up with zeros, and their lengths."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    filled = b"".join(p.ljust(width, b"\0") for p in parts)
    return np.frombuffer(filled, np.uint8).reshape(-1, width), lengths


def _longest_shared(names: np.ndarray, matrix: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each row the longest prefix that it shares with another row of the same name."""
    head = names.astype(">u4").view(np.uint8).reshape(-1, 4)
    order = np.argsort(np.ascontiguousarray(np.hstack([head, matrix])).view(f"V{4 + matrix.shape[1]}").ravel(), kind="stable")
    m, n, size = matrix[order], names[order], lengths[order]
    differs = m[1:] != m[:-1]
    shared = np.where(differs.any(axis=1), differs.argmax(axis=1), matrix.shape[1])
    shared = np.where(n[1:] == n[:-1], np.minimum(shared, np.minimum(size[1:], size[:-1])), 0)
    best = np.zeros(len(order), dtype=np.int64)
    best[order] = np.maximum(np.append(shared, 0), np.append(0, shared)) if len(order) else 0
    return best


def _passage_owners(texts: list[bytes], ids: np.ndarray) -> np.ndarray:
    """The least id of each passage of each text (its columns are starts), by a suffix array over all texts."""
    raw = b"".join(t + b"\xff" for t in texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    order = np.array(suffix_array(raw), dtype=np.int64)
    owner = np.searchsorted(ends, order, side="right")
    offset = order - ends[owner] + np.array([len(t) + 1 for t in texts])[owner]
    fits = order + LENGTH < ends[owner]  # the byte that ends a text is not part of it
    order, owner, offset = order[fits], owner[fits], offset[fits]
    least = np.full((len(texts), SPAN + 1), _NONE)
    windows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(raw, np.uint8), LENGTH)
    fresh = np.ones(len(order), dtype=bool)
    for at in range(1, len(order), 1 << 14):
        part = order[at : at + (1 << 14)]
        fresh[at : at + (1 << 14)] = (windows[part] != windows[order[at - 1 : at - 1 + len(part)]]).any(axis=1)
    lows = np.minimum.reduceat(ids[owner], np.flatnonzero(fresh))
    least[owner, offset] = lows[np.cumsum(fresh) - 1]
    return least


def _judge_block(group: pa.Table) -> pa.Table:
    """(_id, tag, start, mask) of the passages of one block that an earlier document holds.

    Each context is cut to what it shares with another place of its anchor on either side, and dropped if that leaves no passage.
    Where an anchor's cut contexts are all the same, their least document owns every passage; the others, each text once,
    go through a suffix array.
    """
    ids, names, pos = np.asarray(group["_id"]), np.asarray(group["name"]), np.asarray(group["pos"])
    texts, lead = group["text"].to_pylist(), np.minimum(pos, SPAN)
    right, right_size = _rows_of_bytes([t[k:] for t, k in zip(texts, lead.tolist())], LENGTH)
    left, left_size = _rows_of_bytes([t[:k][::-1] for t, k in zip(texts, lead.tolist())], SPAN)
    sizes = np.stack([left_size, right_size], axis=1).astype(np.uint8)
    key = np.ascontiguousarray(np.hstack([names.astype(">u4").view(np.uint8).reshape(-1, 4), right, left, sizes]))
    _, one, same, times = np.unique(key.view(f"V{key.shape[1]}").ravel(), return_index=True, return_inverse=True, return_counts=True)
    # A context that stands in several places shares all of itself.
    r = np.where(times > 1, right_size[one], _longest_shared(names[one], right[one], right_size[one]))
    l = np.where(times > 1, left_size[one], _longest_shared(names[one], left[one], left_size[one]))  # noqa: E741
    cut = [texts[i][lead[i] - a : lead[i] + b] if a + b >= LENGTH else b"" for i, a, b in zip(one.tolist(), l.tolist(), r.tolist())]
    index = {t: k for k, t in enumerate(dict.fromkeys(t for t in cut if t))}
    of = np.fromiter((index.get(t, -1) for t in cut), np.int64, len(cut))
    row_of = of[same]
    live = np.flatnonzero(row_of >= 0)
    low = np.full(len(index), _NONE)
    np.minimum.at(low, row_of[live], ids[live])
    kinds: dict[int, set[int]] = {}
    for name, k in zip(names[one].tolist(), of.tolist()):
        if k >= 0:
            kinds.setdefault(name, set()).add(k)
    mixed = np.array(sorted({k for found in kinds.values() if len(found) > 1 for k in found}), dtype=np.int64)
    strings = list(index)
    counts = np.array([len(t) - LENGTH + 1 for t in strings], dtype=np.int64)
    least = np.where(np.arange(SPAN + 1)[None, :] < counts[:, None], low[:, None], _NONE) if len(strings) else np.zeros((0, SPAN + 1), np.int64)
    if len(mixed):
        least[mixed] = _passage_owners([strings[k] for k in mixed], low[mixed])
    bits = (least[row_of[live]] < ids[live, None]) @ (np.int64(1) << np.arange(SPAN + 1, dtype=np.int64))
    mask = bits << (lead[live] - l[same][live])
    some = mask != 0
    tags, start = np.asarray(group["tag"])[live][some], (pos - lead)[live][some]
    return pa.table({"_id": ids[live][some], "tag": pa.array(tags, pa.int32()), "start": start, "mask": mask[some]})


def _judge_shard(group: pa.Table) -> pa.Table:
    """(key, sub, low, wins, mask): which passages of each text an earlier document holds, by one suffix array over the shard."""
    low = np.asarray(group["low"])
    least = _passage_owners(group["text"].to_pylist(), low)
    mask = (least < low[:, None]) @ (np.int64(1) << np.arange(SPAN + 1, dtype=np.int64))
    return group.select(["key", "sub", "low", "wins"]).append_column("mask", pa.array(mask))


def _judge_crowded(crowded: DataFrame) -> DataFrame:
    """The same for crowded anchors: they are split by the bytes next to them until few contexts share what they are dealt by."""
    wins = (F.octet_length("text") - (LENGTH - 1)).alias("wins")
    rows = crowded.select(
        "_id", "tag", "pos", F.col("name").cast("long").alias("key"), F.least("pos", F.lit(SPAN)).cast("int").alias("lead"), wins, "text"
    ).filter("wins > 0").withColumn("sub", F.xxhash64("lead", "text"))
    level = rows.groupBy("key", "sub").agg(F.min("_id").alias("low"), F.max("_id").alias("high"), *(F.first(c).alias(c) for c in ("lead", "wins", "text")))
    judged = decide(table(level.withColumn("core", F.lit(ANCHOR))), _judge_shard, spaced=False).select("key", "sub", "low", "wins", "mask")
    mask = F.when(F.col("_id") > F.col("low"), full("wins")).otherwise(F.col("mask")).alias("mask")
    return rows.select("_id", "tag", "pos", "key", "sub").join(judged, ["key", "sub"]).select("_id", "tag", _start(), mask).filter("mask != 0")


def _start() -> Column:
    return (F.col("pos") - F.least("pos", F.lit(SPAN))).alias("start")


def _cover(text: bytes, starts: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Which bytes the passages cover that start at each set bit from each start on."""
    bits = (masks[:, None] >> np.arange(SPAN + 1)) & 1
    at = (starts[:, None] + np.arange(SPAN + 1))[bits == 1]
    at = at[at <= len(text) - LENGTH]
    steps = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.add.at(steps, at + LENGTH, -1)
    return np.cumsum(steps)[:-1] > 0


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, 1):
        removed, spans, kept = [], [], []
        for text, copy, marks in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            if len(text) >= LENGTH and copy:
                removed.append(len(text))
                spans.append(1)
                kept.append(b"")
                continue
            if not marks or len(text) < LENGTH:
                removed.append(0)
                spans.append(0)
                kept.append(text)
                continue
            gone = _cover(text, np.array([m["start"] for m in marks]), np.array([m["mask"] for m in marks]))
            removed.append(int(gone.sum()))
            spans.append(int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)) == 1)))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        sizes = [len(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())],
            names=["_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (bytes) of every row: what no document with a smaller doc_id holds.

    A text is its UTF-8 bytes, none for a null one. A byte goes if a LENGTH-byte string over it also starts in a document
    with a smaller doc_id; strings overlap, are judged on the input and never cross documents. Rows that share a doc_id
    are not earlier than each other; rows without one come before all others; texts under LENGTH bytes lose nothing; an
    empty table gives no row; other columns are ignored.

    Anchors choose which passages must meet, so that suffix arrays are needed only where anchors agree and their
    surroundings do not: everything around an anchor that is the same in an earlier document goes without one, and
    equal texts are settled by their hashes. The other contexts are dealt by anchor to blocks of about BLOCK and cut to what
    they share with another; a suffix array (Lyndon grouping) over a block's texts brings equal passages together with
    their least document. The contexts of an anchor with over CROWD of them are split in two by longer anchors, whose equal
    contexts fall together, until no more than that share one; suffix arrays compare those too, so no block grows with one
    passage. Texts move once, by id.
    """
    text = whole_text()
    # Not nullable, so that both joins below read the same shuffle of the texts.
    own = (id_or_none().alias("_id"), F.xxhash64(text).bitwiseAND(0xFFFF).cast("int").alias("tag"))
    texts = docs.select(*own, binary_text(text).alias("t"))
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    blobs = texts.mapInArrow(_collect_anchors(buckets), "bucket long, blob binary")
    found = table(blobs.groupBy("bucket").applyInArrow(_shared_anchors, "_id long, tag int, pos long, kind byte, name int"))

    low = F.greatest(F.col("pos") - SPAN, F.lit(0))
    around = F.substring("t", (low + 1).cast("int"), (F.col("pos") + LENGTH - low).cast("int")).alias("text")
    direct = found.filter("kind = 0").select("_id", "tag", _start(), F.expr(f"shiftleft(1L, cast(least(pos, {SPAN}) + 1 as int)) - 1").alias("mask"))
    compared = found.filter("kind = 1")
    count = max(1, -(-compared.count() // BLOCK))
    dealt = compared.join(texts, ["_id", "tag"]).select("_id", "tag", "pos", "name", around)
    marks = direct.union(dealt.groupBy(F.pmod("name", F.lit(count)).alias("block")).applyInArrow(_judge_block, "_id long, tag int, start long, mask long"))
    crowded = found.filter("kind = 2")
    if not crowded.isEmpty():
        marks = marks.union(_judge_crowded(crowded.join(texts, ["_id", "tag"]).select("_id", "tag", "pos", "name", around)))

    hashed = docs.select(*own, F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    repeated = hashed.groupBy("h1", "h2").agg(F.min("_id").alias("low"), F.max("_id").alias("high")).filter(F.col("low") != F.col("high"))
    # A whole copy is marked by a start before the text.
    copies = hashed.join(repeated, ["h1", "h2"]).filter(F.col("_id") > F.col("low")).select("_id", "tag", F.lit(-1).cast("long").alias("start"), F.lit(0).cast("long").alias("mask"))
    # Spread first: a text's marks come from many blocks, so combining them before the shuffle saves nothing.
    spread = marks.union(copies).repartition("_id", "tag")
    per_text = spread.groupBy("_id", "tag").agg((F.min("start") < 0).alias("copy"), F.collect_list(F.struct("start", "mask")).alias("marks"))
    cut = texts.join(per_text, ["_id", "tag"], "left").select("_id", "t", "copy", "marks").mapInArrow(_cut, "_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.select(as_id("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")
