"""Removal of passages that repeat across the corpus, by the shortest runs that make a passage.

A text is cut into lines at line breaks and after sentence ends. What is looked for are equal
- runs of two whole lines or more and `MIN_WORDS` words or more,
- runs of `LONE_WORDS` words or more inside one line, whatever stands around them,
- whole documents, however short.
For each line the shortest such run that begins with it and the shortest that ends with it are candidates, and so is
every run of LONE_WORDS words inside a line. These depend on nothing outside the run, and every repeated passage is a
union of them, so none is lost. Their rolling hashes over line (or word) hashes are grouped over the whole corpus, one row
a document and hash. Of equal ones the first (lowest doc_id, then place) is kept. Neighbouring candidates of a document
that repeat one other document at the same distance are one range; each range is compared with the first occurrence
byte by byte, but for the blanks between lines (or between words, inside a line), and removed.

Every removed line or word has an equal one earlier in this order, so one occurrence always stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.kernels import RangeHash, Words, _blank, buffer, frugal, mix, words
from siltstone.llm.storage import set_aside, written

MIN_LINES = 2
MIN_WORDS = 12
#: Words of a run inside one line that make a passage: over 50.
LONE_WORDS = 51

_BLANKS = b" \t\n\x0b\x0c\r"
_WORD = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_NO_ID = -(1 << 63)


def line_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines of all texts end, with the blanks after them, and the n + 1 line numbers at which texts begin.

    A line ends with a run of blanks that holds a line break or follows a sentence end, and with its text. The lines of a
    text joined are the text.
    """
    n = len(raw)
    blank = _blank[raw]
    head = np.zeros(n + 1, bool)
    head[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = blank[:-1]
    before &= ~head[:n]
    begin = np.flatnonzero(blank & ~before)
    after = np.zeros(n, bool)
    after[:-1] = blank[1:]
    after &= ~head[1:]
    end = np.flatnonzero(blank & ~after) + 1
    breaks = np.flatnonzero(raw == 0x0A)
    broken = np.searchsorted(breaks, begin) < np.searchsorted(breaks, end)
    mark = raw[np.maximum(begin - 1, 0)] if n else raw
    ended = ((mark == 0x2E) | (mark == 0x21) | (mark == 0x3F)) & ~head[begin]
    tails = offsets[1:][offsets[1:] > offsets[:-1]]
    found = np.unique(np.concatenate([end[broken | ended], tails]))
    return found, np.searchsorted(found, offsets, "right")


def line_ends(raw: bytes) -> list[int]:
    """Where the lines of one text end."""
    return line_table(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0].tolist()


def word_ends(raw: bytes) -> list[int]:
    """Where words end, with the blanks after them."""
    return [m.end() for m in _WORD.finditer(raw)]


def plain(raw: bytes, by_words: int) -> bytes:
    """The lines (or words) without the blanks around them, one a line."""
    if by_words:
        return b"\n".join(raw.split())
    ends = line_ends(raw)
    return b"\n".join(raw[a:b].strip(_BLANKS) for a, b in zip([0, *ends], ends, strict=False))


def _lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, RangeHash, Words]:
    """Hash and number of words of all lines; the n + 1 line numbers at which texts begin; hashes of bytes; all words."""
    raw, offsets = buffer(column)
    end, first = line_table(raw, offsets)
    start = np.concatenate([[0], end[:-1]]).astype(np.int64) if len(end) else end
    w = words(raw, offsets)
    low, upto = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    stop = np.where(upto > low, np.append(w.end, 0)[upto - 1], start) if len(end) else end
    of_bytes = RangeHash.of_bytes(raw)
    return of_bytes(start, stop), upto - low, first, of_bytes, w


def _key_columns() -> dict[str, Column]:
    """A key of a row: its id and the hash of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), "_key": F.xxhash64(text)}


def line_runs(n_words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First line and last line + 1 of the shortest passages that begin or end with each line, and of texts that hold none."""
    total = np.concatenate([[0], np.cumsum(n_words)])
    at = np.arange(len(n_words))
    low, high = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    end = np.maximum(np.searchsorted(total, total[at] + MIN_WORDS), at + MIN_LINES)
    begin = np.minimum(np.searchsorted(total, total[at + 1] - MIN_WORDS, "right") - 1, at + 1 - MIN_LINES)
    on, back = end <= high, begin >= low
    size = total[first[1:]] - total[first[:-1]]
    small = np.flatnonzero((size > 0) & ((size < MIN_WORDS) | (np.diff(first) < MIN_LINES)))
    pairs = np.concatenate([at[on], begin[back], first[small]]), np.concatenate([end[on], at[back] + 1, first[small + 1]])
    key = np.unique(pairs[0] * (len(at) + 1) + pairs[1])
    return key // (len(at) + 1), key % (len(at) + 1)


def word_runs(n_words: np.ndarray, of_bytes: RangeHash, w: Words) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of LONE_WORDS words inside one line."""
    long = np.flatnonzero(n_words >= LONE_WORDS)
    if not len(long):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    upto, sizes = np.cumsum(n_words)[long], n_words[long]
    held = np.cumsum(sizes)
    place = np.arange(held[-1])
    left = np.repeat(held, sizes) - place
    word = np.repeat(upto, sizes) - left
    runs = RangeHash(mix(of_bytes(w.start[word], w.end[word]) + np.uint64(LONE_WORDS)))
    ok = place[left >= LONE_WORDS]
    return word[ok], runs(ok, ok + LONE_WORDS)


def chunks(rows: DataFrame) -> DataFrame:
    """_id, _key, h, spans: the candidates, one row a text and hash, with all places of the hash in the text in order.

    span: first line or word * 2**32 + their number * 2 + 1 if they are words.
    """
    names = ["_id", "_key", "h", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                hashes, n_words, first, of_bytes, w = _lines(part.column(2))
                if not len(hashes):
                    continue
                b, e = line_runs(n_words, first)
                t = np.searchsorted(first, b, "right") - 1
                span = ((b - first[t]) << 32) + (e - b) * 2
                word, h = word_runs(n_words, of_bytes, w)
                u = np.searchsorted(w.first, word, "right") - 1
                text = np.concatenate([t, u])
                span = np.concatenate([span, ((word - w.first[u]) << 32) + (LONE_WORDS * 2 + 1)])
                h = np.concatenate([RangeHash(mix(hashes))(b, e), h])
                order = np.lexsort((span, h, text))
                text, span, h = text[order], span[order], h[order]
                at = np.flatnonzero(np.append(True, (text[1:] != text[:-1]) | (h[1:] != h[:-1])))
                spans = pa.ListArray.from_arrays(pa.array(np.append(at, len(h)).astype(np.int32)), pa.array(span))
                who = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(h[at].view(np.int64)), spans], names=names)

    return rows.select("_id", "_key", "text").mapInArrow(frugal(run), "_id long, _key long, h long, spans array<long>")


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of ordered columns change."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def ranges(later: DataFrame) -> DataFrame:
    """_id, _key, words, size, begins, f_id, f_key, f_begin: candidates of a text that repeat another at one distance, joined.

    later: _id, _key, spans, f_id, f_key, f_span. words: 1 if places are words, 0 if they are lines. Each row is one
    range of the first occurrence and all places of the text that repeat it.
    """
    names = ["_id", "_key", "words", "size", "begins", "f_id", "f_key", "f_begin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("parts")
            spans, f_span = parts.flatten().flatten()
            item = np.repeat(np.arange(len(spans)), spans.value_lengths().to_numpy())
            of_item = np.repeat(np.arange(batch.num_rows), parts.value_lengths().to_numpy())
            span, f, group = spans.flatten().to_numpy(), f_span.to_numpy()[item], of_item[item]
            i, k, f_i, f_k = (batch.column(c).to_numpy() for c in ("_id", "_key", "f_id", "f_key"))
            # The first occurrence itself stays.
            other = ((i != f_i) | (k != f_k))[group] | (span != f)
            span, f, group = span[other], f[other], group[other]
            begin, by_words, size = span >> 32, span & 1, (span & 0xFFFFFFFF) >> 1
            shift = begin - (f >> 32)
            order = np.lexsort((begin, shift, by_words, group))
            begin, by_words, size, shift, group = (x[order] for x in (begin, by_words, size, shift, group))
            heads = _heads(group, by_words, shift)
            run_no = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(begin)))) << 33
            far = np.maximum.accumulate(begin + size + run_no) - run_no if len(begin) else begin
            new = np.ones(len(begin), bool)
            new[1:] = begin[1:] > far[:-1]
            new[heads] = True
            at = np.flatnonzero(new)
            begin, by_words, shift, group, end = begin[at], by_words[at], shift[at], group[at], far[np.append(at[1:], len(far)) - 1] if len(at) else far
            size, f_begin = end - begin, begin - shift
            order = np.lexsort((begin, size, f_begin, by_words, group))
            begin, by_words, size, f_begin, group = (x[order] for x in (begin, by_words, size, f_begin, group))
            at = _heads(group, by_words, f_begin, size)
            begins = pa.ListArray.from_arrays(pa.array(np.append(at, len(begin)).astype(np.int32)), pa.array(begin))
            group = group[at]
            yield pa.RecordBatch.from_arrays([pa.array(i[group]), pa.array(k[group]), pa.array(by_words[at]), pa.array(size[at]), begins, pa.array(f_i[group]), pa.array(f_k[group]), pa.array(f_begin[at])], names=names)

    grouped = later.groupBy("_id", "_key", "f_id", "f_key").agg(F.collect_list(F.struct("spans", "f_span")).alias("parts"))
    return grouped.mapInArrow(frugal(run), "_id long, _key long, words long, size long, begins array<long>, f_id long, f_key long, f_begin long")


def bodies(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """f_id, f_key, words, size, f_begin, body: the bytes of every wanted range."""
    kinds = [*((c, pa.int64()) for c in ("f_id", "f_key", "words", "size", "f_begin")), ("body", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for i, k, text, spans in zip(*(batch.column(c).to_pylist() for c in ("_id", "_key", "text", "spans")), strict=True):
                raw = (text or "").encode()
                ends: dict[int, list[int]] = {}
                for s in spans:
                    w, n, b = s["words"], s["size"], s["f_begin"]
                    if w not in ends:
                        ends[w] = [0, *(word_ends(raw) if w else line_ends(raw))]
                    out.append((i, k, w, n, b, raw[ends[w][b] : ends[w][b + n]].strip(_BLANKS)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], schema=pa.schema(kinds))

    spans = wanted.distinct().groupBy("f_id", "f_key").agg(F.collect_list(F.struct("words", "size", "f_begin")).alias("spans"))
    # A text that stands twice under one id is read once. All columns are kept, so that one shuffle of the texts serves this and the last join.
    one = rows.join(spans, (F.col("_id") == F.col("f_id")) & (F.col("_key") == F.col("f_key"))).drop("f_id", "f_key").dropDuplicates(["_id", "_key"])
    return one.mapInArrow(frugal(run), "f_id long, f_key long, words long, size long, f_begin long, body binary")


def removals(rows: DataFrame) -> DataFrame:
    """_id, _key, found: array of (words, size, begins, body), one row per text that holds later occurrences."""
    all_chunks = written(chunks(rows), "line-chunks")
    # Most candidates stand once: their hashes alone tell, before their places are shuffled.
    counted = all_chunks.groupBy("h").agg(F.count("*").alias("n"), F.max(F.size("spans")).alias("most"))
    repeated = written(counted.where("n > 1 or most > 1").select("h"), "line-hashes")
    again = written(all_chunks.join(repeated, "h"), "line-repeats")
    groups = again.groupBy("h").agg(F.min(F.struct("_id", "_key", F.get("spans", F.lit(0)).alias("span"))).alias("f"))
    # Written, so that both sides of the join come from shuffles of their own and a hot hash can be split.
    groups = written(groups.select("h", F.col("f._id").alias("f_id"), F.col("f._key").alias("f_key"), F.col("f.span").alias("f_span")), "line-firsts")
    later = again.join(groups, "h").where("_id <> f_id or _key <> f_key or size(spans) > 1")
    found = written(ranges(later), "line-ranges")
    span = ["f_id", "f_key", "words", "size", "f_begin"]
    return found.join(bodies(rows, found.select(span)), span).groupBy("_id", "_key").agg(F.collect_list(F.struct("words", "size", "begins", "body")).alias("found"))


def cleaned(raw: bytes, lines: list[int], found: list[dict]) -> tuple[str | None, int, int]:
    """What is left of a text whose lines end there (None: all of it), and the whole lines and the words removed from it."""
    ends = {0: [0, *lines]}
    gone: list[list[int]] = []
    for s in found:
        w, n, body = s["words"], s["size"], s["body"]
        if w not in ends:
            ends[w] = [0, *word_ends(raw)]
        own, other = ends[w], None
        for b in s["begins"]:
            part = raw[own[b] : own[b + n]]
            if part.strip(_BLANKS) != body:
                other = plain(body, w) if other is None else other
                if plain(part, w) != other:
                    continue
            gone.append([own[b], own[b + n]])
    if not gone:
        return None, 0, 0
    apart: list[list[int]] = []
    for a, b in sorted(gone):
        if apart and a <= apart[-1][1]:
            apart[-1][1] = max(apart[-1][1], b)
        else:
            apart.append([a, b])
    left = b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in apart)], [*(a for a, _ in apart), len(raw)], strict=True))
    n_gone = sum(max(0, bisect_right(ends[0], b) - bisect_left(ends[0], a) - 1) for a, b in apart)
    return left.decode(), n_gone, sum(len(raw[a:b].split()) for a, b in apart)


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with the text that is left, n_lines, n_removed_lines and n_removed_words.

    docs: doc_id, text and any other columns. A null text stays null and an empty one empty. A later copy of a whole
    document is left empty, unless it is blank. Rows that share id and text are one document that stands twice: they get the same text.
    A null id comes first in the order. An empty table gives no rows.
    """
    added = ["n_lines", "n_removed_lines", "n_removed_words"]
    names = [c for c in docs.columns if c not in (*added, "_id", "_key", "found")]
    docs = docs.select(names).withColumn("text", F.col("text").cast("string"))
    rows = docs.withColumns(_key_columns())
    joined = rows.join(removals(rows), ["_id", "_key"], "left").select(*names, "found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column("text"), batch.column("found")
            raw, offsets = buffer(texts)
            ends, first = line_table(raw, offsets)
            counts = np.zeros((3, batch.num_rows), np.int64)
            counts[0] = np.diff(first)
            changed, left = np.zeros(batch.num_rows, bool), []
            for t in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
                lines = (ends[first[t] : first[t + 1]] - offsets[t]).tolist()
                text, counts[1, t], counts[2, t] = cleaned(raw[offsets[t] : offsets[t + 1]].tobytes(), lines, found[t].as_py())
                if text is not None:
                    changed[t] = True
                    left.append(text)
            texts = pc.replace_with_mask(texts, pa.array(changed), pa.array(left, pa.string()))
            arrays = [texts if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c) for c in counts)], names=[*names, *added])

    return joined.mapInArrow(frugal(run), docs.withColumns({c: F.lit(0).cast("long") for c in added}).schema)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the columns it has, and the text that is left."""
    held, restored = set_aside(docs)
    return restored(line_dedup(held))
