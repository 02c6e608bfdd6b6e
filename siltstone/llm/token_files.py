"""Token ids in binary files, compressed by a Re-Pair grammar.

One file holds one run of documents in ascending order. Its ids lie in blocks of whole documents; every block has
its own grammar. Re-Pair replaces the most frequent pairs of neighbouring symbols by new symbols, again and
again, until no pair is frequent enough; pairs never cross the end of a document. All pairs are counted in every
round, and those that are more frequent than the pairs they overlap with are replaced together. A
block stores its rules and how many ids each of them expands to, so a reader finds the symbols of a document, or
of any range of its ids, without decoding what lies before.

File, little-endian:
    magic "RPR1", u32 number of blocks, u64 length of the header that follows
    header: per block u64 place, u64 bytes, u32 documents, u64 ids
    block:  u32 first free symbol, u32 rules, u32 documents, u64 symbols, u64 symbol width in bits,
            rules u32 x 2 (left, right; a symbol of a rule is an id or an earlier rule), expansion lengths u32,
            doc_id i64 and a null flag u8 per document, first symbol u64 per document and one more,
            first id u64 per document and one more, symbols (bits, high ones first, without gaps)
"""

from __future__ import annotations

import io
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.llm.kernels import frugal
from siltstone.llm.storage import filesystem, worker_folder, written
from siltstone.llm.tokens import encoder, slices

MAGIC = b"RPR1"
#: Ids up to which documents share a block; a longer document has one of its own.
BLOCK_IDS = 1 << 21
#: Occurrences below which a pair is not replaced, and uses below which a rule waits for another round.
LEAST, LEAST_USES = 8, 4
#: Pairs are first counted by a hash of so many bits.
SLOT_BITS = 20
#: Bytes after which a task goes on in another file.
FILE_BYTES = 1 << 30


def _alternate(where: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Of every run of neighbouring places every other one, from the left (a mask)."""
    new_run = np.ones(len(where), bool)
    new_run[1:] = right[where[:-1]] != where[1:]
    begin = np.flatnonzero(new_run)
    return (np.arange(len(where)) - np.repeat(begin, np.diff(np.append(begin, len(where))))) & 1 == 0


def compress(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """symbols, first symbol of every document (and one more), rules (n, 2), expansion lengths, first free symbol.

    Symbols stay at the places of their first ids, linked to their neighbours; only places whose pair is frequent are
    looked at. A pair can get more frequent only by places next to a symbol of the same round, so a pair that was
    counted once and is rare is rare for good, and after a round only those places are counted anew.
    """
    base, n = int(ids.max()) + 1 if len(ids) else 1, len(ids)
    filled = first[1:] > first[:-1]
    heads = first[:-1][filled]
    s = np.append(ids, 0).astype(np.uint32)
    # The neighbours of every place; n stands for none.
    left, right = np.arange(-1, n, dtype=np.int32), np.arange(1, n + 2, dtype=np.int32)
    left[heads], right[np.append(heads[1:], n) - 1] = n, n
    # How often the pair at a place stands, if it is frequent, and the number of the pair.
    rank, pair = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    gone, marked = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    rules, size, free = [], np.ones(base, np.int64), base
    codes, active = np.zeros(0, np.int64), np.zeros(0, np.int64)
    often = np.append((np.bincount(ids, minlength=1) >= LEAST)[ids], False)
    fresh = np.flatnonzero(often[:n] & often[right[:n]])
    while True:
        # New pairs: those that are frequent get numbers. Most are rare, and so are whole slots of them.
        one, two = s[fresh], s[right[fresh]]
        slot = (one * np.uint32(0x9E3779B1) ^ two * np.uint32(0x85EBCA77)) >> np.uint32(32 - SLOT_BITS)
        maybe = np.flatnonzero((np.bincount(slot, minlength=1) >= LEAST)[slot])
        fresh = fresh[maybe]
        found = pa.array(one[maybe].astype(np.int64) << 32 | two[maybe]).dictionary_encode()
        which, known = found.indices.to_numpy(), found.dictionary.to_numpy()
        many = np.bincount(which, minlength=len(known)) >= LEAST
        pair[fresh] = (np.cumsum(many) - 1 + len(codes))[which]
        codes = np.concatenate([codes, known[many]])
        active = np.concatenate([active, fresh[many[which]]])
        active.sort(kind="stable")
        p = pair[active]
        count = np.bincount(p, minlength=len(codes)).astype(np.int32)
        keep = count[p] >= LEAST
        rank[active[~keep]] = 0
        active, p = active[keep], p[keep]
        if not len(active):
            break
        c = rank[active] = count[p]
        # A pair is replaced where no pair that it overlaps with is more frequent.
        top = (c >= rank[left[active]]) & (c >= rank[right[active]])
        at, p_at = active[top], p[top]
        apart = _alternate(at, right)
        at, p_at = at[apart], p_at[apart]
        used = np.bincount(p_at, minlength=len(codes)) >= LEAST_USES
        if not used.any():
            most = int(count.argmax())
            at = active[p == most]
            at = at[_alternate(at, right)]
            p_at = np.full(len(at), most)
            used[most] = True
        at, p_at = at[used[p_at]], p_at[used[p_at]]
        s[at] = free + (np.cumsum(used) - 1)[p_at]
        taken = right[at]
        gone[taken] = True
        right[at] = right[taken]
        left[right[at]] = at
        new = codes[used]
        rules.append(np.stack([new >> 32, new & 0xFFFFFFFF], 1))
        size = np.concatenate([size, size[new >> 32] + size[new & 0xFFFFFFFF]])
        free += len(new)
        # The pairs at and before the new symbols are others now.
        before = left[at]
        rank[taken] = rank[at] = rank[before] = 0
        active = active[rank[active] > 0]
        marked[at] = marked[before] = True
        marked[at[right[at] == n]] = marked[n] = False
        fresh = np.flatnonzero(marked)
        marked[fresh] = False
    there = ~gone[:n]
    before_doc = np.concatenate([[0], np.cumsum(there)])[first]
    rules_out = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return s[:n][there], before_doc.astype(np.uint64), rules_out.astype(np.uint32), size[base:].astype(np.uint32), base


class Grammar:
    """Rules with their expansions side by side, so symbols are expanded by one gather."""

    def __init__(self, rules: np.ndarray, lengths: np.ndarray, base: int):
        self.size = np.concatenate([np.ones(base, np.int64), lengths.astype(np.int64)])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.empty(int(self.size.sum()), np.uint32)
        self.flat[:base] = np.arange(base)
        # Rules whose sides are all known are expanded together.
        highest, k = rules.max(1).astype(np.int64) - base if len(rules) else np.zeros(0, np.int64), 0
        while k < len(rules):
            later = np.flatnonzero(highest[k:] >= k)
            upto = k + int(later[0]) if len(later) else len(rules)
            ends = self.start[base + upto] if base + upto < len(self.start) else len(self.flat)
            self.flat[self.start[base + k] : ends] = self.expand(rules[k:upto].ravel())
            k = upto

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        n = self.size[symbols]
        ends = np.cumsum(n)
        return self.flat[np.repeat(self.start[symbols] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _block(doc_ids: list[int | None], ids: np.ndarray, first: np.ndarray) -> bytes:
    symbols, sym_first, rules, lengths, base = compress(ids, first)
    width = max(1, (base + len(rules) - 1).bit_length())
    out = io.BytesIO()
    out.write(struct.pack("<IIIQQ", base, len(rules), len(doc_ids), len(symbols), width))
    out.write(rules.astype("<u4").tobytes())
    out.write(lengths.astype("<u4").tobytes())
    out.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    out.write(np.array([x is None for x in doc_ids], "u1").tobytes())
    out.write(sym_first.astype("<u8").tobytes())
    out.write(first.astype("<u8").tobytes())
    bits = np.unpackbits(symbols.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)[:, 32 - width :]
    out.write(np.packbits(bits.ravel()).tobytes())
    return out.getvalue()


class Block:
    """One block of a file, opened for reading documents or ranges of their ids."""

    def __init__(self, raw: bytes):
        self.base, n_rules, n_docs, n_symbols, width = struct.unpack_from("<IIIQQ", raw)
        at = struct.calcsize("<IIIQQ")

        def part(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out

        self.rules = part("<u4", 2 * n_rules).reshape(-1, 2)
        self.lengths = part("<u4", n_rules)
        ids, null = part("<i8", n_docs), part("u1", n_docs)
        self.doc_ids = [None if x else int(i) for i, x in zip(ids, null, strict=True)]
        self.first_symbol, self.first_id = part("<u8", n_docs + 1).astype(np.int64), part("<u8", n_docs + 1).astype(np.int64)
        wide = np.zeros((n_symbols, 32), np.uint8)
        wide[:, 32 - width :] = np.unpackbits(part("u1", -(-width * n_symbols // 8)), count=width * n_symbols).reshape(n_symbols, width)
        self.symbols = np.packbits(wide, axis=1).view(">u4").ravel().astype(np.uint32)
        self.grammar = Grammar(self.rules, self.lengths, self.base)

    def document(self, k: int) -> np.ndarray:
        return self.grammar.expand(self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]])

    def all_ids(self) -> np.ndarray:
        return self.grammar.expand(self.symbols)

    def ids(self, k: int, start: int, stop: int) -> np.ndarray:
        """Ids start to stop - 1 of document k: expansion lengths tell which symbols hold them."""
        s = self.symbols[self.first_symbol[k] : self.first_symbol[k + 1]]
        ends = np.cumsum(self.grammar.size[s])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skipped = ends[a - 1] if a else 0
        return self.grammar.expand(s[a:b])[start - skipped : stop - skipped]


_HEAD, _ENTRY = struct.Struct("<4sIQ"), struct.Struct("<QQIQ")


class Writer:
    """Collects documents into blocks and writes the file under a name of its own, then renames it."""

    def __init__(self, folder: str, name: str):
        self.fs, root = filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{root}/{name}-{os.urandom(6).hex()}.rpr"
        self.blocks: list[tuple[int, int]] = []
        self.body = self.fs.open_output_stream(self.name + ".body")
        self.entries: list[tuple[int, int, int, int]] = []
        self.size = self.n_ids = self.n_docs = 0

    def block(self, doc_ids: list[int | None], ids: np.ndarray, first: np.ndarray) -> None:
        raw = _block(doc_ids, ids, first)
        self.body.write(raw)
        self.entries.append((self.size, len(raw), len(doc_ids), len(ids)))
        self.size += len(raw)
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)

    def close(self) -> str:
        self.body.close()
        head = _HEAD.size + _ENTRY.size * len(self.entries)
        with self.fs.open_output_stream(self.name) as out, self.fs.open_input_stream(self.name + ".body") as body:
            out.write(_HEAD.pack(MAGIC, len(self.entries), head))
            for place, n, docs, ids in self.entries:
                out.write(_ENTRY.pack(place + head, n, docs, ids))
            while chunk := body.read(1 << 22):
                out.write(chunk)
        self.fs.delete_file(self.name + ".body")
        return self.name


def entries(file) -> list[tuple[int, int, int, int]]:
    """place, bytes, documents and ids of every block of an open file."""
    file.seek(0)
    magic, n, head = _HEAD.unpack(file.read(_HEAD.size))
    if magic != MAGIC:
        raise ValueError("not a token file")
    return list(_ENTRY.iter_unpack(file.read(head - _HEAD.size)))[:n]


def blocks(file) -> Iterator[Block]:
    for place, n, _, _ in entries(file):
        file.seek(place)
        yield Block(file.read(n))


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents in ascending doc_id order (nulls first, then by text) and return the manifest.

    Manifest, one row per file: shard and part (ascending with doc_id), path, n_docs, n_ids, start (ids of all files
    before). A file holds file_bytes and a block at most, however much a task is given. Only files that the manifest
    names count, so attempts of lost executors leave nothing that is read. A null text is an empty one; repeated rows
    are written as often as they stand; an empty table makes no file.
    """
    spark = docs.sparkSession
    folder = worker_folder(spark, "token-files", folder)
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("_tie"))
    ordered = rows.repartitionByRange(shards, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out, shard, parts = encoder(tokenizer), None, None, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if held:
                first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[2]) for h in held]))])
                out.block([d for h in held for d in h[0]], np.concatenate([h[1] for h in held]), first)
                held.clear()

        def named() -> pa.RecordBatch:
            row = {"shard": pa.array([shard], pa.int32()), "part": pa.array([parts], pa.int32()), "path": [out.close()]}
            return pa.RecordBatch.from_pydict(row | {"n_docs": pa.array([out.n_docs], pa.int64()), "n_ids": pa.array([out.n_ids], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            shard = batch.column(2)[0].as_py()
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(texts, 1_500_000):
                out = out or Writer(folder, f"shard-{shard:06d}-{parts:06d}")
                ids, begin = enc.encode(texts[a:b], end_id)
                if held and sum(len(h[1]) for h in held) + len(ids) > BLOCK_IDS:
                    flush()
                held.append((doc_ids[a:b], ids, begin))
                if out.size >= file_bytes:
                    flush()
                    yield named()
                    out, parts = None, parts + 1
        if out is not None:
            flush()
            yield named()

    manifest = written(ordered.mapInArrow(frugal(save), "shard int, part int, path string, n_docs long, n_ids long"), "token-manifest")
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    # One small row per file: the running total is the only step that sees them together.
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0))).withColumn("folder", F.lit(folder))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids of every document."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, _ = filesystem(row["folder"])
                at = row["start"]
                with fs.open_input_file(row["path"]) as file:
                    for block in blocks(file):
                        ids = block.all_ids()
                        raw, first = memoryview(ids.astype("<u4").tobytes()), block.first_id
                        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                        out = {"doc_id": pa.array(block.doc_ids, pa.int64()), "start": first[:-1] + at, "n_tokens": np.diff(first), "ids_crc32": pa.array(crc, pa.int64())}
                        if with_ids:
                            out["ids"] = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))
                        yield pa.RecordBatch.from_pydict(out)
                        at += int(first[-1])

    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("folder", "path", "start").repartition(n, "path").mapInArrow(frugal(load), kinds)
