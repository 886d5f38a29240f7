"""Removal of repeated substrings, by refinement of bucket pointers at sampled offsets.

A suffix array that is refined from buckets gives each offset a bucket by its first q bytes, then refines a bucket by the
buckets at later offsets. Here only the offsets that can decide keep a pointer. Every window of ``span`` bytes names
one offset inside it: that of its smallest q-gram hash, the leftmost of equals. Equal windows name the same offset, so a
repeat is always found from the bucket of that q-gram.

1. Initial buckets: the pointers of each document are dealt out by the hash of their q-gram. Pointers with one content, the bytes that all
   their windows span, hold the same windows: the smallest document's stands for them, and the windows of the others' all repeat. What stands
   in a bucket of one document only is dropped (most of it).
2. Refinement: for what is left, one pointer for each content, its document sends the bytes. A pointer's
   identifiers at the next offset to the left and to the right come from those of the offset before (one multiply and
   add each), so the 50-byte window at each start is known from the bucket, the identifier of its left part and the
   identifier of its right part; of equal identifiers the smallest document wins.
3. Hot buckets are refined in further rounds. Their pointers are dealt out, so that no task has a bucket; a window that a smaller document
   shows there is settled. Runs of windows that stay open go on as pointers of a refined bucket: windows with nearly the same number of bytes
   before the q-gram share most bytes, and buckets of 18, 9, 3 and 1 such numbers are told apart by the identifiers of those bytes. Only what
   is still hot takes a further round, so rows go with the pointers, not with their windows. Which buckets are hot is told by a histogram of fixed
   size over hashes of buckets; it decides the way of a pointer, not the result.
4. The starts that also occur in a smaller document go back to their document as runs; it cuts the union out.

Identifiers are 64-bit hashes.

Defined cases: null text counts as empty; texts shorter than ``span`` lose nothing; a null doc_id is no smaller and no
larger than any other and loses nothing; rows that repeat a doc_id don't see each other's strings, since neither is
smaller; an empty table gives an empty result; other columns are ignored; texts of any length are treated whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import as_documents, drop, stage
from tessera.llm.shingles import _letters, _Powers, mix

_U = np.uint64
Q = 16
#: Bytes of text for each initial bucket group, and of a slab; a slab's offsets must fit in SLAB_BITS.
BUCKET_BYTES, SLAB, SLAB_BITS = 64 << 20, 1 << 20, 21
#: Cells of the histogram that tells hot buckets; one is hot with over the HOT-th part of all pointers, at every size; parts that its pointers are dealt to.
CELLS, HOT, DEALS = 1 << 16, 1000, 64
#: Numbers of bytes before the q-gram that share a refined bucket, by round.
WIDTHS = (18, 9, 3, 1)
#: Contents of a q-gram that a batch sends to the q-gram's bucket; further ones of several documents are spread by content.
BUSY = 64
_LEFT, _RIGHT = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def pointers(data: bytes, starts: np.ndarray, ends: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Named offsets of the texts at [start, end) of data: q-gram hash, offset, and the first and last window naming it."""
    n = len(data)
    if n < span:
        return tuple(np.zeros(0, t) for t in (_U, np.int64, np.int64, np.int64))
    raw = np.frombuffer(data, np.uint8)
    up, down = _Powers.of(n)
    sums = np.concatenate([[_U(0)], np.cumsum(_letters()[raw] * up)])
    grams = mix((sums[Q:] - sums[:-Q]) * down[: n - Q + 1])
    ranked = (grams >> _U(SLAB_BITS) << _U(SLAB_BITS)) | np.arange(len(grams), dtype=_U)
    width, have = span - Q + 1, 1
    while have < width:
        step = min(have, width - have)
        ranked = np.minimum(ranked[:-step], ranked[step:])
        have += step
    named = (ranked & _U((1 << SLAB_BITS) - 1)).astype(np.int64)
    text_of = np.full(n, -1, np.int64)
    for k, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
        text_of[a : max(a, b - span + 1)] = k
    owner = text_of[: len(named)]
    change = np.flatnonzero((named[1:] != named[:-1]) | (owner[1:] != owner[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change, [len(named)]]) - 1
    valid = owner[first] >= 0
    first, last = first[valid], last[valid]
    return grams[named[first]], named[first], first, last


def _slabs(texts: list[bytes], span: int) -> Iterator[tuple]:
    """(data, row, shift, starts, ends) slabs: many short texts together, a long one in parts that overlap by span - 1."""
    at = 0
    while at < len(texts):
        if len(texts[at]) > SLAB:
            for cut in range(0, len(texts[at]) - span + 1, SLAB):
                part = texts[at][cut : cut + SLAB + span - 1]
                yield part, np.array([at]), np.array([cut]), np.array([0]), np.array([len(part)])
            at += 1
            continue
        stop, size = at, 0
        while stop < len(texts) and size + len(texts[stop]) <= SLAB:
            size += len(texts[stop])
            stop += 1
        ends = np.cumsum([len(t) for t in texts[at:stop]])
        yield b"".join(texts[at:stop]), np.arange(at, stop), np.zeros(stop - at, np.int64), ends - np.array([len(t) for t in texts[at:stop]]), ends
        at = stop


def _contents(data: bytes, offset: np.ndarray, first: np.ndarray, last: np.ndarray, span: int) -> np.ndarray:
    """An identifier of the bytes that a pointer's windows span, and of its place in them: equal ones hold the same windows."""
    up, down = _Powers.of(len(data))
    sums = np.concatenate([[_U(0)], np.cumsum(_letters()[np.frombuffer(data, np.uint8)] * up)])
    size = last + span - first
    return mix(mix((sums[first + size] - sums[first]) * down[first]) ^ (size.astype(_U) << _U(8)) ^ (offset - first).astype(_U))


def _breaks(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in a column; the first row does."""
    n = len(columns[0])
    return np.concatenate([np.ones(min(n, 1), bool), np.logical_or.reduce([c[1:] != c[:-1] for c in columns])]) if n else np.zeros(0, bool)


def _split(rows: np.ndarray, by: np.ndarray) -> list[np.ndarray]:
    """Rows, in parts of one value of ``by``, which is sorted."""
    return np.split(rows, np.flatnonzero(np.diff(by)) + 1) if len(rows) else []


def _named_grams(span: int, buckets: int):
    """Rows (bucket, grams, contents, doc ids, shared) for the reducers, and rows (doc, contents) that a smaller document of the batch holds too."""
    names = ["bucket", "doc_id", "grams", "contents", "docs", "shared"]
    types = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            ids = batch.column("doc_id").to_numpy()
            grams, contents, docs = [np.zeros(0, _U)], [np.zeros(0, _U)], [np.zeros(0, np.int64)]
            for data, row, _, starts, ends in _slabs(texts, span):
                gram, offset, first, last = pointers(data, starts, ends, span)
                if len(gram):
                    grams.append(gram)
                    contents.append(_contents(data, offset, first, last, span))
                    docs.append(ids[row[np.searchsorted(ends, offset, "right")]] if len(row) > 1 else np.full(len(gram), ids[row[0]]))
            gram, content, doc = np.concatenate(grams), np.concatenate(contents), np.concatenate(docs)
            order = np.lexsort((doc, content, gram))
            gram, content, doc = gram[order], content[order], doc[order]
            new = _breaks(gram, content)
            least = doc[np.flatnonzero(new)[np.cumsum(new) - 1]]
            out: list[tuple] = []
            # A smaller document of the batch holds the same: these documents know at once; that one stands for all elsewhere.
            known = np.flatnonzero((doc > least) & _breaks(gram, content, doc))
            known = known[np.argsort(doc[known], kind="stable")]
            for part in _split(known, doc[known]):
                out.append((None, int(doc[part[0]]), None, content[part].view(np.int64), None, None))
            gram, content, doc = gram[new], content[new], doc[new]
            head = np.flatnonzero(_breaks(gram))
            count = np.diff(np.append(head, len(gram)))
            mixed = np.repeat(np.minimum.reduceat(doc, head) < np.maximum.reduceat(doc, head), count) if len(head) else np.zeros(0, bool)
            spread = mixed & (np.arange(len(gram)) - np.repeat(head, count) >= BUSY)
            bucket = (np.where(spread, content, gram) % _U(buckets)).astype(np.int64)
            # Half of a q-gram's hash is enough beside its bucket: where two meet by chance, more is sent than must be. Sorted ids pack well.
            half = (gram >> _U(32)).astype(np.uint32).view(np.int32)
            send = np.lexsort((doc, bucket))
            for some in _split(send, bucket[send]):
                out.append((int(bucket[some[0]]), None, half[some], content[some].view(np.int64), doc[some], mixed[some]))
            for at in range(0, max(1, len(out)), 2000):
                columns = list(zip(*out[at : at + 2000], strict=True)) if out else [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)

    return run


_NAMED = "bucket long, doc_id long, grams array<int>, contents array<long>, docs array<long>, shared array<boolean>"


def _shared_grams(group: pa.Table) -> pa.Table:
    """Of one bucket group: the contents that a smaller document holds too (settled), and one document for each other content of a q-gram of several."""

    def flat(name):
        column = group.column(name).combine_chunks()
        return (column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])).to_numpy(zero_copy_only=False)

    gram, content, doc, known = (flat(c) for c in ("grams", "contents", "docs", "shared"))
    order = np.lexsort((doc, content, gram))
    gram, content, doc, known = gram[order], content[order], doc[order], known[order].astype(bool)
    new, head = _breaks(gram, content), np.flatnonzero(_breaks(gram))
    settled = doc > doc[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(doc) else np.zeros(0, bool)
    if len(head):
        # The smallest documents of a q-gram's contents decide: if they are one, it holds every window of the q-gram first.
        firsts = np.flatnonzero(new)
        heads = np.searchsorted(firsts, head)
        some = (np.minimum.reduceat(doc[firsts], heads) < np.maximum.reduceat(doc[firsts], heads)) | np.logical_or.reduceat(known, head)
        mixed = np.repeat(some, np.diff(np.append(head, len(gram))))
    else:
        mixed = np.zeros(0, bool)
    hit = settled | (new & mixed)
    content, doc, settled = content[hit], doc[hit], settled[hit]
    order = np.lexsort((content, settled, doc))
    content, doc, settled = content[order], doc[order], settled[order]
    first = np.flatnonzero(_breaks(doc, settled))
    offsets = np.append(first, len(doc)).astype(np.int32)
    return pa.table({"doc_id": doc[first], "settled": settled[first], "contents": pa.ListArray.from_arrays(pa.array(offsets), pa.array(content))})


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Marks (start * 64 + further starts) of the starts from low to high, where neighbours are joined."""
    new = np.flatnonzero(np.concatenate([[True], low[1:] != high[:-1] + 1]))
    first, last = low[new], high[np.append(new[1:], len(low)) - 1]
    pieces = (last - first) // 64 + 1
    start = np.repeat(first, pieces) + 64 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    return start * 64 + np.minimum(63, np.repeat(last, pieces) - start)


def _contexts(span: int):
    """Rows (gram, doc, offset, low, high, bytes) of the wanted pointers, and rows (doc, marks) of the settled ones."""
    names = ["gram", "doc_id", "fp", "at", "lead", "more", "around", "marks"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column("text")]
            ids, fps = batch.column("doc_id").to_numpy(), batch.column("fp").to_numpy()
            settled, wanted = ([x.values.flatten().to_numpy(zero_copy_only=False).view(_U) for x in batch.column(c)] for c in ("settled", "wanted"))
            both = [np.concatenate(x) for x in zip(settled, wanted, strict=True)]
            ranks = [np.argsort(x, kind="stable") for x in both]
            for data, row, shift, starts, ends in _slabs(texts, span):
                gram, offset, low, high = pointers(data, starts, ends, span)
                if not len(gram):
                    continue
                content = _contents(data, offset, low, high, span)
                local = np.searchsorted(ends, offset, "right") if len(row) > 1 else np.zeros(len(gram), np.int64)
                way = np.zeros(len(gram), np.int8)  # 1: settled, 2: wanted
                edges = np.searchsorted(local, np.arange(len(row) + 1))
                for k in range(len(row)):
                    own, rank, i = content[edges[k] : edges[k + 1]], ranks[row[k]], row[k]
                    if len(rank) and len(own):
                        at = rank[np.minimum(np.searchsorted(both[i], own, sorter=rank), len(rank) - 1)]
                        way[edges[k] : edges[k + 1]] = np.where(both[i][at] == own, np.where(at < len(settled[i]), 1, 2), 0)
                place = (low - starts[local] + shift[local]).astype(np.int64)
                gone, stay = np.flatnonzero(way == 1), np.flatnonzero(way == 2)
                if len(gone):
                    parts = _split(gone, local[gone])
                    own = np.array([part[0] for part in parts])
                    marks = [_joined(place[part], (place + high - low)[part]) for part in parts]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(own), pa.int64()), pa.array(ids[row[local[own]]]), pa.array(fps[row[local[own]]]), *(pa.nulls(len(own), t) for t in types[3:7]), pa.array(marks, types[7])], names)
                if len(stay):
                    size = high[stay] + span - low[stay]
                    pieces = [data[a : a + n] for a, n in zip(low[stay].tolist(), size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(gram[stay].view(np.int64)), pa.array(ids[row[local[stay]]]), pa.array(fps[row[local[stay]]]), pa.array(place[stay]), pa.array((offset - low)[stay].astype(np.int32)), pa.array((high - low)[stay].astype(np.int32)), pa.array(pieces, pa.binary()), pa.nulls(len(stay), types[7])], names)

    return run


_CONTEXTS = "gram long, doc_id long, fp long, at long, lead int, more int, around binary, marks array<long>"


def _window_keys(gram: np.ndarray, lead: np.ndarray, more: np.ndarray, around: list[bytes], span: int) -> tuple[np.ndarray, ...]:
    """(row, step, identifier) of every window of every pointer, and the identifiers of the bytes left and right of each; step counts starts from the pointer's first."""
    n, width = len(gram), span - Q
    joined = np.frombuffer(b"".join(around), np.uint8)
    size = np.array([len(x) for x in around], np.int64)
    base = np.cumsum(size) - size
    letters = _letters()
    left, right = np.zeros((n, width + 1), _U), np.zeros((n, width + 1), _U)
    anchor = base + lead
    for t in range(1, width + 1):  # the identifier at the next offset from that of the one before
        have = lead >= t
        byte = np.where(have, joined[np.where(have, anchor - t, 0)], 0)
        left[:, t] = left[:, t - 1] * _LEFT + letters[byte]
        after = anchor + Q + t - 1
        have = after < base + size
        byte = np.where(have, joined[np.where(have, after, 0)], 0)
        right[:, t] = right[:, t - 1] * _RIGHT + letters[byte]
    counts = more.astype(np.int64) + 1
    row = np.repeat(np.arange(n), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    before = lead[row] - step  # bytes of the window to the left of the q-gram
    key = mix(mix(left[row, before] ^ gram[row]) + mix(right[row, width - before]) * _LEFT + before.astype(_U))
    return row, step, key, left, right


def _open_pointers(at: np.ndarray, lead: np.ndarray, around: list[bytes], row: np.ndarray, step: np.ndarray, span: int, width: int, gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Runs of open windows as pointers of refined buckets: each one's old row, and its gram, at, lead, more and around."""
    node = (lead[row] - step) // width
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1) | (node[1:] != node[:-1])])) if len(row) else np.zeros(0, np.int64)
    r, s, node, more = row[first], step[first], node[first], np.diff(np.append(first, len(row))) - 1
    # All windows of a refined bucket share that many bytes before the q-gram and that many after it.
    before = node * width
    after = np.maximum(0, span - Q - before - width + 1)
    key = mix(mix(left[r, before] ^ gram[r]) + mix(right[r, after]) * _RIGHT + node.astype(_U) + _U(1))
    pieces = [around[i][a : a + n] for i, a, n in zip(r.tolist(), s.tolist(), (more + span).tolist(), strict=True)]
    return r, [pa.array(key.view(np.int64)), pa.array(at[r] + s), pa.array((lead[r] - s).astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(pieces, pa.binary())]


_REFINED = "doc_id long, fp long, mark long, gram long, at long, lead int, more int, around binary"


def _repeats(span: int, width: int = 0):
    """Reads pointers sorted by (gram, doc); yields the runs of starts whose window occurs in a smaller document, and with a ``width`` the open windows as pointers of refined buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept_key, kept_doc = None, np.zeros(0, _U), np.zeros(0, np.int64)  # of the gram that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy().view(_U)
            doc, fp, at = (batch.column(c).to_numpy() for c in ("doc_id", "fp", "at"))
            lead, more = batch.column("lead").to_numpy().astype(np.int64), batch.column("more").to_numpy()
            around = [x.as_buffer().to_pybytes() for x in batch.column("around")]
            row, step, key, left, right = _window_keys(gram, lead, more, around, span)
            if gram[0] != last:
                kept_key, kept_doc = kept_key[:0], kept_doc[:0]
            every, docs = np.concatenate([kept_key, key]), np.concatenate([kept_doc, doc[row]])
            order = np.lexsort((docs, every))
            new = np.concatenate([[True], every[order][1:] != every[order][:-1]])
            least = np.empty(len(every), np.int64)
            least[order] = docs[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
            hit = np.flatnonzero(least[len(kept_key) :] < doc[row])
            r, s = row[hit], step[hit]
            head = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] != s[:-1] + 1)])) if len(r) else np.zeros(0, np.int64)
            runs = np.diff(np.append(head, len(r))) - 1
            settled = [pa.array(doc[r[head]]), pa.array(fp[r[head]]), pa.array((at[r[head]] + s[head]) * 64 + runs)]
            if width:
                names = ["doc_id", "fp", "mark", "gram", "at", "lead", "more", "around"]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([*settled, *(pa.nulls(len(head), t) for t in types)], names)
                open_ = np.flatnonzero(least[len(kept_key) :] >= doc[row])
                r, refined = _open_pointers(at, lead, around, row[open_], step[open_], span, width, gram, left, right)
                yield pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(fp[r]), pa.nulls(len(r), pa.int64()), *refined], names)
            else:
                yield pa.RecordBatch.from_arrays(settled, ["doc_id", "fp", "mark"])
            # Carry over the last gram's identifiers, each with its smallest document.
            last = gram[-1]
            own = np.concatenate([np.ones(len(kept_key), bool) if gram[0] == last else np.zeros(len(kept_key), bool), gram[row] == last])
            firsts = order[new]
            firsts = firsts[own[firsts]]
            kept_key, kept_doc = every[firsts], docs[firsts]

    return run


def cut_out(data: bytes, marks: np.ndarray, span: int) -> tuple[list[tuple[int, int]], bytes]:
    """Removed [start, end) runs and the remaining bytes, for marks of start * 64 + further starts."""
    if not len(marks):
        return [], data
    marks = np.sort(marks)
    low, high = marks >> 6, (marks >> 6) + (marks & 63) + span
    reach = np.maximum.accumulate(high)
    new = np.flatnonzero(np.concatenate([[True], low[1:] > reach[:-1]]))
    runs = list(zip(low[new].tolist(), reach[np.append(new[1:] - 1, len(low) - 1)].tolist(), strict=True))
    kept, at = [], 0
    for a, b in runs:
        kept.append(data[at:a])
        at = b
    return runs, b"".join([*kept, data[at:]])


def _cut(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, spans, digests, kept_texts = [], [], [], [], []
            for text, marks in zip(batch.column("text"), batch.column("marks"), strict=True):
                data = text.as_buffer().to_pybytes()
                runs, kept = cut_out(data, marks.values.to_numpy(zero_copy_only=False) if marks.is_valid else np.zeros(0, np.int64), span)
                sizes.append(len(data))
                removed.append(len(data) - len(kept))
                spans.append(len(runs))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (sizes, removed, spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _over(cells: DataFrame, limit: float) -> list[int]:
    return [r["cell"] for r in cells.where(F.col("n") > limit).select("cell").collect()]


def _hot_cells(cells: DataFrame) -> list[int]:
    """The cells of a histogram of CELLS cells with over the HOT-th part of its sum: fewer than HOT of them."""
    return _over(cells, (cells.agg(F.sum("n")).first()[0] or 0) / HOT)


_POINTER = ("gram", "doc_id", "fp", "at", "lead", "more", "around")


def _cell() -> Column:
    return F.pmod(F.xxhash64("gram"), F.lit(CELLS)).cast("int")


def _cells(pointers_: DataFrame) -> DataFrame:
    return pointers_.groupBy(_cell().alias("cell")).agg(F.count("*").alias("n"))


def _parted(pointers_: DataFrame, hot: list[int]) -> tuple[DataFrame, DataFrame]:
    """The pointers in hot cells, and the others."""
    told = F.broadcast(pointers_.sparkSession.createDataFrame([(c,) for c in hot], "cell int"))  # fewer than HOT rows
    return tuple(pointers_.withColumn("cell", _cell()).join(told, "cell", how).drop("cell") for how in ("left_semi", "left_anti"))


def _refined(pointers_: DataFrame, span: int, width: int) -> DataFrame:
    """Pointers of hot buckets, dealt out: settled runs (mark), and the windows that stay open as pointers of refined buckets."""
    deal = F.pmod(F.xxhash64("doc_id", "fp", "at"), F.lit(DEALS))
    dealt = pointers_.withColumn("deal", deal).repartition("gram", "deal").drop("deal").sortWithinPartitions("gram", "doc_id")
    return dealt.mapInArrow(_repeats(span, width), _REFINED)


def repeated_starts(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, fp, marks: for each document with repeats, the starts of its repeated windows (start * 64 + further ones)."""
    if not Q < span < Q + 64:
        raise ValueError(f"span must lie between {Q + 1} and {Q + 63}")
    texts = docs.where("doc_id is not null")
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(24, math.ceil(total / BUCKET_BYTES))
    named = stage(texts.select("doc_id", "text").mapInArrow(_named_grams(span, buckets), _NAMED), "named-grams")
    columns = ["grams", "contents", "docs", "shared"]
    shared = named.where("bucket is not null").select("bucket", *columns).groupBy("bucket").applyInArrow(lambda t: _shared_grams(t.select(columns)), "doc_id long, settled boolean, contents array<long>")
    told = shared.unionByName(named.where("bucket is null").select("doc_id", F.lit(True).alias("settled"), "contents"))
    wanted = stage(told.groupBy("doc_id").agg(F.collect_list(F.when(F.col("settled"), F.col("contents"))).alias("settled"), F.collect_list(F.when(~F.col("settled"), F.col("contents"))).alias("wanted")), "wanted-grams")
    drop(named)
    found = stage(texts.join(wanted, "doc_id").select("doc_id", "fp", "text", "settled", "wanted").mapInArrow(_contexts(span), _CONTEXTS), "contexts")
    drop(wanted)
    pointers_ = found.where("gram is not null").select(*_POINTER)
    cells = _cells(pointers_)
    hot = _hot_cells(cells)
    known = found.where("gram is null").select("doc_id", "fp", "marks")
    one = F.array("mark").alias("marks")
    rounds = []
    if hot:
        limit = (cells.agg(F.sum("n")).first()[0] or 0) / HOT
        rows, pointers_ = _parted(pointers_, hot)
        for width in WIDTHS:
            rounds.append(stage(_refined(rows, span, width), "refined"))
            known = known.unionByName(rounds[-1].where("mark is not null").select("doc_id", "fp", one))
            rows = rounds[-1].where("mark is null").select(*_POINTER)
            # A bucket of the last round is one window, of which each deal leaves one document.
            if width == WIDTHS[-1] or not (hot := _over(_cells(rows), limit)):
                pointers_ = pointers_.unionByName(rows)
                break
            rows, cold = _parted(rows, hot)
            pointers_ = pointers_.unionByName(cold)
    repeats = pointers_.repartition("gram").sortWithinPartitions("gram", "doc_id").mapInArrow(_repeats(span), "doc_id long, fp long, mark long")
    marks = stage(repeats.select("doc_id", "fp", one).unionByName(known).groupBy("doc_id", "fp").agg(F.flatten(F.collect_list("marks")).alias("marks")), "marks")
    drop(found, *rounds)
    return marks


def remove_repeats(docs: DataFrame, span: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    texts = as_documents(docs).withColumn("fp", F.xxhash64("text"))
    marks = repeated_starts(texts, span)
    return texts.join(marks, ["doc_id", "fp"], "left").select("doc_id", "text", "marks").mapInArrow(_cut(span), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
