"""Operator 1: exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are hashed word shingles.

1. *Column blocks.*  Every document's distinct shingles go to column blocks
   (ranges of the hash).  A block counts each column's documents and answers
   only for columns that more than one document has.
2. *Size-derived bound.*  A set of ``n`` shingles can reach the threshold ``t``
   only with a set that shares one of its first ``n - ceil(t n) + 1`` columns in
   any fixed order of columns.  Ordered from the rarest up, columns of a single
   document need no partner, so documents with enough of them leave here.
3. *Stars.*  Each bounded column links its documents to its smallest one: such
   pairs are verified, lead by lead, and give classes of near copies.
4. *Row blocks.*  Columns that still hold two classes or more give block pairs:
   documents meet in a pair of blocks if they share such a column.  A task
   multiplies the bounded columns of two blocks, accumulating overlap counts per
   pair of documents of different classes, and drops pairs that cannot reach
   ``overlap >= t (|x| + |y| - overlap)`` with all that lies beyond the bound.
5. *Verification.*  Whole sets are fetched for the pairs left only; a task emits
   a spanning forest of the links it finds, never all pairs of a group.

A large class has row blocks of its own, which never meet each other there; the
rest share blocks of about ``block_rows``.  Joins on a column or class that a
large part of the rows may hold are dealt over several tasks.

With ``count_links`` every link is counted.  Step 5 then gives all links between
classes.  Within a class, pairs of its row blocks are multiplied whole: a task
has the counts of its two blocks as one matrix and returns sums by row, no pairs.

Columns that ``hot`` or more documents of one chunk share are pre-aggregated
before the shuffle: the chunk sends one posting for the column.

Sets are compared by 64-bit shingle hashes; equal sets (checksum of 128 bits
and size) are one row of the matrix, linked by their smallest document.

Defined cases: a null or wordless text has an empty set and links with nothing
(its component is itself); a text of fewer than ``width`` words is one shingle;
rows with the same id are one node; a row with a null id is returned with a
null component and no number of links; links are to rows, so that a row's equal
ones count, with their ids equal or not; other columns of the input are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impulsar.llm.common import components, cut, partitions, salted_join
from impulsar.llm.words import Words, mix64, release, shingle_set

WIDTH, THRESHOLD = 5, 75
CHUNK_SHINGLES, HOT, BLOCK_ROWS, BATCH_BYTES = 2_000_000, 64, 512, 1 << 21
_KEY_BITS = 40
_HOT_DF = 65535
#: Shingles of a class's row block, and columns of a dense part of a product.
BLOCK_SHINGLES, DENSE_COLUMNS = 1 << 20, 1024
#: Columns of this many documents or more are marked, so that joins on them can be dealt over tasks.
MANY, _MARK = 512, 1 << 62


def document_sets(batches, id_column: str, text_column: str, width: int):
    """(row of the batch, batch, shingle set) for each document, a bounded slice of text at a time."""
    for batch in batches:
        texts, ids = batch.column(text_column), batch.column(id_column)
        step = max(1, int(len(texts) * BATCH_BYTES / max(texts.nbytes, 1)))
        for start in range(0, len(texts), step):
            words = Words(texts.slice(start, step), lower=True)
            for row in range(words.rows):
                yield batch, start + row, ids[start + row].as_py(), shingle_set(words.row_hashes(row), width)
            words = None
            release(texts.slice(start, step).nbytes)


def checksums(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit checksums of a set, whatever its order."""
    return tuple(np.array([shingles.sum(dtype=np.uint64), mix64(shingles).sum(dtype=np.uint64)], dtype=np.uint64).view(np.int64).tolist())


def _planes(values: np.ndarray, width: int) -> bytes:
    """Little-endian byte planes, so that zero high bytes compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data, width: int) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


_STAGE1 = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("docs", pa.binary()), ("keys", pa.binary()), ("dfs", pa.binary()), ("meta", pa.binary())])
_STAGE1_SQL = "block long, chunk long, docs binary, keys binary, dfs binary, meta binary"


def _row(block, chunk, docs=b"", keys=b"", dfs=b"", meta=b""):
    return {"block": block, "chunk": chunk, "docs": docs, "keys": keys, "dfs": dfs, "meta": meta}


def _post_chunk(chunk: int, ids: list, sets: list[np.ndarray], bits: int, hot: int):
    """Postings of one chunk by column block, its documents' sizes and checksums, its own hot columns."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sums = np.array([checksums(s) for s in sets], dtype=np.int64).reshape(-1, 2)
    known = np.array([x is not None for x in ids], dtype=np.int64)
    meta = np.column_stack([np.array([x or 0 for x in ids], dtype=np.int64), known, sizes, sums])
    yield _row(-1 - chunk, chunk, meta=meta.astype("<i8").tobytes())
    every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    if not len(every):
        return
    sets.clear()  # they are in ``every`` now
    docs = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
    if not known.all():
        keep = known[docs] > 0
        every, docs = every[keep], docs[keep]
    order = np.argsort(every, kind="stable")
    every, docs = every[order], docs[order]
    del order
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    runs = np.diff(np.append(first, len(every)))
    many = np.repeat(runs >= hot, runs)
    block = (every >> np.uint64(64 - bits)).astype(np.int64)
    key = (every << np.uint64(bits)) >> np.uint64(64 - _KEY_BITS)
    if many.any():
        column = (block[many].astype(np.uint64) << np.uint64(_KEY_BITS)) | key[many]
        yield _row(-1 - chunk, chunk, _planes(docs[many], 4), _planes(column, 8), _planes(np.full(int(many.sum()), _HOT_DF), 3))
        leads = np.zeros(len(every), dtype=bool)
        leads[first] = True
        docs = np.where(many, np.uint32(0xFFFFFFFF), docs)
        sent = ~many | leads
        block, key, docs = block[sent], key[sent], docs[sent]
    del every, first, runs, many
    edges = np.searchsorted(block, np.arange((1 << bits) + 1))
    for b in np.flatnonzero(np.diff(edges)):
        part = slice(edges[b], edges[b + 1])
        yield _row(int(b), chunk, _planes(docs[part], 4), _planes(np.diff(key[part], prepend=np.uint64(0)), 5))


def _post(width: int, bits: int, hot: int, chunk_shingles: int, id_column: str, text_column: str):
    def run(batches):
        number, ids, sets, held = 0, [], [], 0
        part = TaskContext.get().partitionId() << 24

        def flush():
            rows, size = [], 0
            for row in _post_chunk(part + number, ids, sets, bits, hot):
                rows.append(row)
                size += len(row["docs"]) + len(row["keys"]) + len(row["meta"])
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(rows, _STAGE1)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _STAGE1)

        for _, _, doc, found in document_sets(batches, id_column, text_column, width):
            ids.append(doc)
            sets.append(found)
            held += len(found) + 16
            if held >= chunk_shingles:
                yield from flush()
                number, ids, sets, held = number + 1, [], [], 0
                release()
        if ids:
            yield from flush()
            ids, sets = [], []
            release()

    return run


def _count_block(bits: int):
    """A column block: documents per column, answered to the chunks whose documents share it."""

    def run(key, table):
        block = key[0].as_py()
        if block < 0:  # a chunk's own rows pass through
            return table.select(_STAGE1.names)
        keys, docs, chunks = [], [], []
        for chunk, d, k in zip(table["chunk"].to_pylist(), table["docs"].to_pylist(), table["keys"].to_pylist(), strict=True):
            keys.append(np.cumsum(_unplanes(k, 5), dtype=np.uint64))
            docs.append(_unplanes(d, 4).astype(np.int64))
            chunks.append(np.full(len(docs[-1]), chunk))
        keys, docs, chunks = np.concatenate(keys), np.concatenate(docs), np.concatenate(chunks)
        order = np.argsort(keys, kind="stable")
        keys, docs, chunks = keys[order], docs[order], chunks[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        runs = np.diff(np.append(first, len(keys)))
        is_hot = np.maximum.reduceat(docs == 0xFFFFFFFF, first)
        df = np.where(is_hot, _HOT_DF, np.minimum(runs, _HOT_DF - 1))
        df = np.repeat(df, runs)
        keep = (df > 1) & (docs != 0xFFFFFFFF)
        keys, docs, chunks, df = keys[keep], docs[keep], chunks[keep], df[keep]
        order = np.argsort(chunks, kind="stable")
        keys, docs, chunks, df = keys[order] | (np.uint64(block) << np.uint64(_KEY_BITS)), docs[order], chunks[order], df[order]
        del order, first, runs, is_hot, keep
        release(table.nbytes)
        edges = np.append(np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1]))), len(chunks)) if len(chunks) else []
        rows = [_row(-1, int(chunks[a]), _planes(docs[a:b], 4), _planes(keys[a:b], 8), _planes(df[a:b], 3)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.Table.from_pylist(rows, _STAGE1)

    return run


_DOCS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("prefix", pa.list_(pa.int64()))])


def _bound(threshold: int, many: int):
    """A chunk's documents with the columns that the size bound leaves, rarest first."""

    def run(key, table):
        meta, docs, keys, dfs = None, [], [], []
        for row in table.to_pylist():
            if row["meta"]:
                meta = np.frombuffer(row["meta"], dtype="<i8").reshape(-1, 5)
            if row["docs"]:
                docs.append(_unplanes(row["docs"], 4).astype(np.int64))
                keys.append(_unplanes(row["keys"], 8))
                dfs.append(_unplanes(row["dfs"], 3).astype(np.int64))
        sizes = meta[:, 2]
        need = sizes + (-threshold * sizes) // 100 + 1
        prefix = [[]] * len(meta)
        if docs:
            docs, keys, dfs = np.concatenate(docs), np.concatenate(keys), np.concatenate(dfs)
            shared = np.bincount(docs, minlength=len(meta))
            left = need - (sizes - shared)
            keep = left[docs] > 0
            docs, keys, dfs = docs[keep], keys[keep], dfs[keep]
            order = np.lexsort((keys, dfs, docs))
            docs, keys = docs[order], keys[order].astype(np.int64) | np.where(dfs[order] >= many, _MARK, 0)
            edges = np.searchsorted(docs, np.arange(len(meta) + 1))
            prefix = [keys[a : min(b, a + max(n, 0))] for a, b, n in zip(edges[:-1], edges[1:], left, strict=True)]
        release(table.nbytes)
        ids = pa.array(meta[:, 0], mask=meta[:, 1] == 0)
        return pa.Table.from_arrays([ids, pa.array(sizes), pa.array(meta[:, 3]), pa.array(meta[:, 4]), pa.array(prefix, pa.list_(pa.int64()))], schema=_DOCS)

    return run


def _reaches(overlap, left, right, threshold: int):
    return (100 + threshold) * overlap >= threshold * (left + right)


def bounded_pairs(prefixes: list[np.ndarray], sizes: np.ndarray, classes: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a ``left`` and a ``right`` row of different classes that the overlap of their bounded columns leaves possible.

    The columns that two sets share come within the bound of both, or after the
    end of one of the bounds: at most ``size - bound`` of them.
    """
    beyond = -(-threshold * sizes // 100) - 1
    columns, inverse = np.unique(np.concatenate([prefixes[y] for y in right]), return_inverse=True)
    rows = np.repeat(right, [len(prefixes[y]) for y in right])[np.argsort(inverse, kind="stable")]
    starts = np.searchsorted(np.sort(inverse), np.arange(len(columns) + 1))
    us, vs = [], []
    for x in left:
        at = np.searchsorted(columns, prefixes[x])
        at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == prefixes[x])]
        n = starts[at + 1] - starts[at]
        if not n.sum():
            continue
        met, counts = np.unique(rows[np.arange(n.sum()) + np.repeat(starts[at] - (np.cumsum(n) - n), n)], return_counts=True)
        most = np.minimum(counts + np.maximum(beyond[x], beyond[met]), np.minimum(sizes[x], sizes[met]))
        met = met[_reaches(most, sizes[x], sizes[met], threshold) & (classes[met] != classes[x])]
        us.append(np.full(len(met), x))
        vs.append(met)
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(sets: dict, classes: dict, pairs, threshold: int) -> list[tuple[int, int]]:
    """Links among the pairs, as a spanning forest over the classes; a node's sets are several if its id is repeated."""
    up: dict = {}

    def find(c):
        while c in up:
            c = up[c]
        return c

    found = []
    for u, v in pairs:
        a, b = find(classes[u]), find(classes[v])
        if a == b:
            continue
        if any(_reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold) for x in sets[u] for y in sets[v]):
            up[max(a, b)] = min(a, b)
            found.append((u, v))
    return found


def linked_sets(sets: dict, pairs, threshold: int) -> list[tuple]:
    """All links among the pairs, as (u, v, key of u's set, key of v's set); sets are by node and key."""
    return [(u, v, a, b) for u, v in pairs for a, x in sets[u].items() for b, y in sets[v].items() if _reaches(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), threshold)]


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Overlap counts of two blocks of sets: the product of their incidence matrices, column by column.

    Columns that few rows hold add one to each pair that shares them; the others
    are multiplied as dense matrices, some at a time.
    """
    shape = len(left), len(right)
    out = np.zeros(shape)
    columns, inverse = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    split = sum(map(len, left))
    sides = []
    for entries, block in ((inverse[:split], left), (inverse[split:], right)):
        order = np.argsort(entries, kind="stable")
        sides.append((np.repeat(np.arange(len(block)), [len(x) for x in block])[order], np.searchsorted(entries[order], np.arange(len(columns) + 1))))
    (rows, at), (others, other_at) = sides
    n, m = np.diff(at), np.diff(other_at)
    dense = n * m > shape[0] * shape[1] // 100 + 1
    few = np.repeat(np.where(dense, 0, m), n)  # partners of each entry on the left
    starts, edges = np.repeat(other_at[:-1], n), np.concatenate(([0], np.cumsum(few)))
    low = 0
    while low < len(few) and edges[-1] > edges[low]:
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + (1 << 22), side="right")) - 1)
        k = few[low:high]
        partner = np.arange(k.sum()) + np.repeat(starts[low:high] - (edges[low:high] - edges[low]), k)
        out += np.bincount(np.repeat(rows[low:high], k) * shape[1] + others[partner], minlength=out.size).reshape(shape)
        low = high
    kept = np.flatnonzero(dense)
    for part in (kept[c : c + DENSE_COLUMNS] for c in range(0, len(kept), DENSE_COLUMNS)):
        a, b = np.zeros((shape[0], len(part)), np.float32), np.zeros((shape[1], len(part)), np.float32)
        for c, column in enumerate(part.tolist()):
            a[rows[at[column] : at[column + 1]], c] = 1
            b[others[other_at[column] : other_at[column + 1]], c] = 1
        out += a @ b.T
    return out


_COUNTED = "f1 long, f2 long, n_shingles long, n long"


def _class_links(threshold: int):
    """Links of each set within a pair of row blocks of one class, weighted by the rows that have the sets."""

    def run(key, table):
        i, j = key[1].as_py(), key[2].as_py()
        names = zip(*(table[c].to_pylist() for c in ("f1", "f2", "n_shingles")), strict=True)
        found = {name: (block, weight, np.frombuffer(packed, dtype="<u8")) for name, block, weight, packed in zip(names, table["block"].to_pylist(), table["weight"].to_pylist(), table["shingles"].to_pylist(), strict=True)}
        left = [name for name in found if found[name][0] == i]
        right = left if i == j else [name for name in found if found[name][0] == j]
        counts = np.zeros(0, np.int64)
        if left and right:
            a, b = (np.array([len(found[x][2]) for x in side]) for side in (left, right))
            links = _reaches(overlaps([found[x][2] for x in left], [found[x][2] for x in right]), a[:, None], b[None, :], threshold)
            if i == j:
                np.fill_diagonal(links, False)
            counts = links @ np.array([found[x][1] for x in right])
            if i != j:
                counts = np.concatenate([counts, links.T @ np.array([found[x][1] for x in left])])
        release(table.nbytes)
        every = left if i == j else left + right
        every = [(*name, n) for name, n in zip(every, counts.tolist(), strict=False) if n]
        return pa.Table.from_arrays([pa.array([x[c] for x in every], pa.int64()) for c in range(4)], names=["f1", "f2", "n_shingles", "n"])

    return run


def _bounded(threshold: int):
    """Pairs of two row blocks that may be links."""
    schema = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("u", pa.int64()), ("v", pa.int64()), ("u_class", pa.int64()), ("v_class", pa.int64())])

    def run(key, table):
        i, j = key[0].as_py(), key[1].as_py()
        docs, classes, sizes, block = (table[c].to_numpy() for c in ("doc", "class", "n_shingles", "block"))
        prefixes = [np.array(p, dtype=np.int64) for p in table["prefix"].to_pylist()]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return schema.empty_table()
        u, v = bounded_pairs(prefixes, sizes, classes, left, right, threshold)
        release(table.nbytes)
        if i == j:
            u, v = u[docs[u] < docs[v]], v[docs[u] < docs[v]]
        return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in (np.full(len(u), i), np.full(len(u), j), docs[u], docs[v], classes[u], classes[v])], schema=schema)

    return run


_KEYS = ("f1", "f2", "n_shingles")
_LINKS = pa.schema([(c, pa.int64()) for c in ("u", "v", *[f"{side}_{c}" for side in "uv" for c in _KEYS])])
_LINKS_SQL = ", ".join(f"{c} long" for c in _LINKS.names)


def _block_links(threshold: int, whole: bool):
    """Verified links of a task's pairs: a spanning forest, or the whole with the keys of their sets."""

    def run(key, pairs, rows):
        sets: dict = {}
        for doc, packed, *name in zip(*(rows[c].to_pylist() for c in ("doc", "shingles", *_KEYS)), strict=True):
            sets.setdefault(doc, {})[tuple(name)] = np.frombuffer(packed, dtype="<u8")
        u, v = pairs["u"].to_pylist(), pairs["v"].to_pylist()
        every = sorted(zip(u, v, strict=True))
        if whole:
            found = [(x, y, *a, *b) for x, y, a, b in linked_sets(sets, every, threshold)]
        else:
            classes = dict(zip(u, pairs["u_class"].to_pylist(), strict=True)) | dict(zip(v, pairs["v_class"].to_pylist(), strict=True))
            none = (None,) * 2 * len(_KEYS)
            found = [(x, y, *none) for x, y in spanning({d: list(of.values()) for d, of in sets.items()}, classes, every, threshold)]
        sets.clear()
        release(rows.nbytes)
        return pa.Table.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(len(_LINKS))], schema=_LINKS)

    return run


def _sets(width: int):
    schema = pa.schema([("doc", pa.int64()), *[(c, pa.int64()) for c in _KEYS], ("shingles", pa.binary())])

    def run(batches):
        rows, held = [], 0
        for _, _, doc, found in document_sets(batches, "doc", "text", width):
            rows.append({"doc": doc, **dict(zip(_KEYS, (*checksums(found), len(found)), strict=True)), "shingles": found.astype("<u8").tobytes()})
            held += len(found) * 8
            if held > 1 << 22:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _by_column(postings: DataFrame, columns: DataFrame) -> DataFrame:
    """Postings with a table of one row a column; marked columns are dealt over tasks."""
    marked = F.col("col") >= F.lit(_MARK)
    return postings.where(~marked).join(columns.where(~marked), "col").unionByName(salted_join(postings.where(marked), columns.where(marked), ["col"], "doc"))


def _verified(pairs: DataFrame, sets: DataFrame, place: list[str], threshold: int, whole: bool = False) -> DataFrame:
    """Spanning links of ``pairs`` (place, u, v, u_class, v_class), or the ``whole`` of their links; one task a place."""
    there = [f"at_{p}" for p in place]
    rows = pairs.select(*[F.col(p).alias(a) for p, a in zip(place, there, strict=True)], F.explode(F.array("u", "v")).alias("doc")).distinct().join(sets, "doc")
    return cut(pairs.groupBy(*place).cogroup(rows.groupBy(*there)).applyInArrow(_block_links(threshold, whole), _LINKS_SQL))


def _stars(postings: DataFrame, leads: DataFrame, sets: DataFrame, threshold: int, block_rows: int) -> DataFrame:
    """Links of columns' documents to the columns' smallest documents."""
    near = _by_column(postings, leads).where("doc <> lead").select("lead", "doc", "lead_size", "n_shingles")
    near = cut(near.where(_reaches(F.least("lead_size", "n_shingles"), F.col("lead_size"), F.col("n_shingles"), threshold)).select("lead", "doc").distinct())
    large = cut(near.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_rows)).cast("int").alias("n_blocks")).where("n_blocks > 1"))
    dealt = salted_join(near, large, ["lead"], "doc", "left").withColumn("part", F.pmod(F.xxhash64("doc"), F.coalesce("n_blocks", F.lit(1))))
    return _verified(dealt.select("lead", "part", F.col("lead").alias("u"), F.col("doc").alias("v"), F.col("lead").alias("u_class"), F.col("doc").alias("v_class")), sets, ["lead", "part"], threshold)


def _crossed(postings: DataFrame, classes: DataFrame, prefixes: DataFrame, sets: DataFrame, threshold: int, block_rows: int, whole: bool) -> DataFrame:
    """Links between documents of different classes that share a bounded column; spanning ones if not the ``whole``."""
    live = postings.join(classes.select(F.col("node").alias("doc"), F.col("component").alias("class")), "doc", "left").withColumn("class", F.coalesce("class", "doc"))
    several = live.groupBy("col").agg(F.min("class").alias("low"), F.max("class").alias("high")).where("low < high").select("col")
    live = cut(_by_column(live, several))
    if live.isEmpty():
        return live.sparkSession.createDataFrame(_LINKS.empty_table())
    members = live.select("doc", "class").distinct()
    large = cut(members.groupBy("class").count().where(F.col("count") > block_rows).select("class", F.ceil(F.col("count") / F.lit(block_rows)).alias("n_blocks")))
    n_shared = max(1, -(-members.count() // block_rows))
    own = F.when(F.col("n_blocks").isNotNull(), F.xxhash64("class", F.pmod(F.xxhash64("doc"), F.col("n_blocks")))).otherwise(F.xxhash64(F.lit("shared"), F.pmod(F.xxhash64("class"), F.lit(n_shared))))
    live = cut(salted_join(live, large, ["class"], "doc", "left").withColumn("block", own).drop("n_blocks"))
    # The blocks of a column, but for those that hold none but the document's own class there.
    of_column = live.groupBy("col", F.col("block").alias("other")).agg(F.min("class").alias("low"), F.max("class").alias("high"))
    met = _by_column(live, of_column).where("low <> class OR high <> class").select("doc", "class", "n_shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).distinct()
    rows = met.join(prefixes, ["doc", "n_shingles"]).select("i", "j", "doc", "class", "n_shingles", "block", "prefix")
    pairs = cut(rows.groupBy("i", "j").applyInArrow(_bounded(threshold), "i long, j long, u long, v long, u_class long, v_class long").distinct())
    return _verified(pairs, sets, ["i", "j"], threshold, whole)


def _link_counts(groups: DataFrame, live: DataFrame, classes: DataFrame, sets: DataFrame, crossed: DataFrame, threshold: int, block_rows: int) -> DataFrame:
    """Rows that each set links with, but for those that have the set itself.

    ``groups`` are the sets with their document and number of rows, ``live`` the
    documents that share a bounded column, ``crossed`` all links between classes.
    """
    members = groups.join(live, ["doc", "n_shingles"]).join(classes.select(F.col("node").alias("doc"), F.col("component").alias("class")), "doc", "left")
    members = cut(members.withColumn("class", F.coalesce("class", "doc")))
    held = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block_rows), F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)))
    several = cut(members.groupBy("class").agg(F.count(F.lit(1)).alias("n"), held.alias("n_blocks")).where("n > 1").drop("n"))
    placed = salted_join(members, several, ["class"], "doc").withColumn("block", F.pmod(F.xxhash64(*_KEYS), F.col("n_blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)))
    placed = placed.select("doc", *_KEYS, "weight", "class", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    within = placed.join(sets, ["doc", *_KEYS]).groupBy("class", "i", "j").applyInArrow(_class_links(threshold), _COUNTED)
    ends = [crossed.select(F.col(a).alias("doc"), *[F.col(f"{a}_{c}").alias(c) for c in _KEYS], F.col(b).alias("to"), *[F.col(f"{b}_{c}").alias(f"to_{c}") for c in _KEYS]) for a, b in ("uv", "vu")]
    weights = groups.select(F.col("doc").alias("to"), *[F.col(c).alias(f"to_{c}") for c in _KEYS], F.col("weight").alias("n"))
    between = ends[0].unionByName(ends[1]).join(groups.select("doc", *_KEYS), ["doc", *_KEYS]).join(weights, weights.columns[:-1])
    return within.unionByName(between.select(*_KEYS, "n")).groupBy(*_KEYS).agg(F.sum("n").alias("n"))


def ngram_jaccard_components(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, threshold: int = THRESHOLD, chunk_shingles: int = CHUNK_SHINGLES, hot: int = HOT, block_rows: int = BLOCK_ROWS, many: int = MANY, count_links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id and, with ``count_links``, n_links.

    Two documents link when ``100 * intersection >= threshold * union`` of their
    distinct ``width``-word shingles; ``component_id`` is the smallest id reachable,
    ``n_links`` the number of other rows that a row links with.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    bits = max(4, (4 * partitions(spark) - 1).bit_length())
    posted = docs.mapInArrow(_post(width, bits, hot, chunk_shingles, "doc_id", "text"), _STAGE1_SQL)
    counted = posted.groupBy("block").applyInArrow(_count_block(bits), _STAGE1_SQL)
    rows = cut(counted.groupBy("chunk").applyInArrow(_bound(threshold, many), "doc_id long, n_shingles long, f1 long, f2 long, prefix array<long>"))

    # One document stands for all of the same set.
    same = list(_KEYS)
    filled = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = cut(filled.groupBy(*same).agg(F.min("doc_id").alias("doc"), F.count(F.lit(1)).alias("weight")))
    prefixes = filled.where("size(prefix) > 0").withColumnRenamed("doc_id", "doc").join(groups.drop("weight"), [*same, "doc"]).select("doc", "n_shingles", "prefix")
    postings = cut(prefixes.select("doc", "n_shingles", F.explode("prefix").alias("col")))
    columns = postings.groupBy("col").agg(F.min(F.struct("doc", "n_shingles")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    columns = cut(columns.select("col", F.col("first.doc").alias("lead"), F.col("first.n_shingles").alias("lead_size")))
    postings = cut(_by_column(postings, columns.select("col")))
    texts = docs.withColumnRenamed("doc_id", "doc").join(postings.select("doc").distinct(), "doc")
    sets = cut(texts.mapInArrow(_sets(width), "doc long, f1 long, f2 long, n_shingles long, shingles binary"))
    # Rows that share an id are one node, wordless ones too.
    repeated = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    shared = cut(filled.select("doc_id", *same).join(repeated, "doc_id").join(groups, same).select("doc_id", "doc").distinct())
    of_id = shared.groupBy("doc_id").agg(F.min("doc").alias("v"))
    links = _stars(postings, columns, sets, threshold, block_rows).select("u", "v").unionByName(shared.join(of_id, "doc_id").select(F.col("doc").alias("u"), "v"))
    near = cut(components(links))
    crossed = _crossed(postings, near, prefixes, sets, threshold, block_rows, count_links)
    links = links.unionByName(crossed.select("u", "v"))
    classes = cut(components(links).select(F.col("node").alias("doc"), "component"))

    of_set = groups.join(classes, "doc", "left").select(*same, F.coalesce("component", "doc").alias("component"), "weight")
    if count_links:
        counts = _link_counts(groups, postings.select("doc", "n_shingles").distinct(), near, sets, crossed, threshold, block_rows)
        of_set = of_set.join(cut(counts), same, "left").withColumn("n_links", F.col("weight") - 1 + F.coalesce("n", F.lit(0))).drop("n")
    out = salted_join(rows.select("doc_id", *same), of_set.drop("weight"), same, "doc_id", "left")
    if not shared.isEmpty():
        of_id = of_id.join(classes, F.col("v") == F.col("doc"), "left").select("doc_id", F.coalesce("component", "v").alias("of_id"))
        out = out.join(of_id, "doc_id", "left").withColumn("component", F.coalesce("of_id", "component"))
    known = lambda c: F.when(F.col("doc_id").isNotNull(), c)
    n_links = [known(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links")] if count_links else []
    return out.select("doc_id", "n_shingles", known(F.coalesce("component", "doc_id")).alias("component_id"), *n_links)
