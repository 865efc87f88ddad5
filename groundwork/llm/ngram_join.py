"""N-gram Jaccard self-join of documents as a blocked sparse matrix product.

The incidence matrix (documents by distinct 5-word shingles) is cut in blocks of documents, as they are read, and
blocks of shingles (48-bit hashes dealt by their upper bits). A block of shingles learns which of its columns have
more than one document and answers each block of documents with those entries; columns of one document can add to no
overlap and go. A document left with fewer shared entries than 0.75 of its size cannot reach the bound with any other
and goes too, which is nearly all of a corpus. Equal sets become one row. Of the rest, the rarest s - ceil(0.75 n) + 1
entries index each document: two documents that link share one of them, so groups of the index, linked in stars,
give clusters outside of which nothing can link. Overlaps are accumulated within clusters by products of blocks of
at most `block` documents, over slices of shingles; blocks whose sizes differ by more than the bound never meet, and a
product gives a spanning forest of its links, not its pairs. All of this is exact, up to collisions of hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, lean, materialised, salts_for, spread_join, text_bytes
from ._text import U, Words, flat, mix, pieces

LOW = 40
_SENT = "dest int, block long, a binary, b binary, c binary, d binary"
_ROWS = "doc_id long, n_shingles long, f1 long, f2 long, keys binary"


def _batch(columns, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=names)


def _cut(buckets: int, width: int):
    """Documents to rows for each block of shingles (their entries) and one with the documents themselves."""
    kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    names = ["dest", "block", "a", "b", "c", "d"]

    def run(batches):
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            data, places = flat(batch.column(1))
            ids = batch.column(0)
            for i, j in pieces(places, 2 << 20):
                values, first = Words(data, places[i : j + 1]).shingles(width)
                sets = [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
                n = np.array([len(s) for s in sets], np.int64)
                prints = np.zeros((2, len(sets)), U)
                entries = np.concatenate(sets) if sets else np.zeros(0, U)
                row = np.repeat(np.arange(len(sets)), n)
                filled = np.flatnonzero(n)
                if len(filled):
                    at = (np.cumsum(n) - n)[filled]
                    prints[0, filled] = np.add.reduceat(mix(entries ^ U(0x5851F42D4C957F2D)), at)
                    prints[1, filled] = np.bitwise_xor.reduceat(mix(entries + U(0x14057B7EF767814F)), at)
                own = ids.slice(i, j - i)
                valid = np.array(own.is_valid())
                number = np.array(own.fill_null(0), np.int64)
                where = ((entries >> U(LOW)) % U(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cut = np.searchsorted(where[order], np.arange(buckets + 1))
                low = (entries & U((1 << LOW) - 1))[order]
                row = row[order].astype(np.uint32)
                rows = [(-1 - block % buckets, block, number.tobytes(), valid.tobytes(), n.tobytes(), prints.tobytes())]
                for b in np.flatnonzero(np.diff(cut)):
                    s = slice(cut[b], cut[b + 1])
                    rows.append((int(b), block, row[s].tobytes(), low[s].astype(np.uint32).tobytes(), (low[s] >> U(32)).astype(np.uint8).tobytes(), None))
                yield _batch(zip(*rows), names, kinds)
                block += 1

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of one block of shingles, the entries whose column has more than one document, back by block of documents."""
    dest = table["dest"][0].as_py()
    if dest < 0:
        return table
    blocks = np.array(table["block"])
    a, b, c = ([np.frombuffer(x, t) for x in table[n].to_pylist()] for n, t in (("a", np.uint32), ("b", np.uint32), ("c", np.uint8)))
    of = np.repeat(np.arange(len(blocks)), [len(x) for x in a])
    key = np.concatenate(b).astype(U) | (np.concatenate(c).astype(U) << U(32))
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    size = np.diff(np.append(begin, len(key)))
    df = np.empty(len(key), np.int64)
    df[order] = np.repeat(size, size)
    keep = np.flatnonzero(df > 1)
    row, of, key, df = np.concatenate(a)[keep], of[keep], key[keep], np.minimum(df[keep], 255).astype(np.uint8)
    cut = np.searchsorted(of, np.arange(len(blocks) + 1))
    out = []
    for k in np.flatnonzero(np.diff(cut)):
        s = slice(cut[k], cut[k + 1])
        out.append((dest, int(blocks[k]), row[s].tobytes(), key[s].astype(np.uint32).tobytes(), (key[s] >> U(32)).astype(np.uint8).tobytes(), df[s].tobytes()))
    if not out:
        return table.slice(0, 0)
    return pa.Table.from_batches([_batch(zip(*out), table.column_names, (pa.int32(), pa.int64(), *[pa.binary()] * 4))])


def _gathered(num: int, den: int):
    """Documents of a block, with their shared entries, rarest first, if these can still reach the bound."""

    def run(table: pa.Table) -> pa.Table:
        head, rows, keys, dfs = None, [], [], []
        for dest, a, b, c, d in zip(*(table[n].to_pylist() for n in ("dest", "a", "b", "c", "d"))):
            if dest < 0:
                head = (np.frombuffer(a, np.int64), np.frombuffer(b, bool), np.frombuffer(c, np.int64), np.frombuffer(d, np.int64).reshape(2, -1))
            else:
                rows.append(np.frombuffer(a, np.uint32))
                low = np.frombuffer(b, np.uint32).astype(U) | (np.frombuffer(c, np.uint8).astype(U) << U(32))
                keys.append(low | (U(dest) << U(LOW)))
                dfs.append(np.frombuffer(d, np.uint8))
        number, valid, n, prints = head
        row = np.concatenate(rows) if rows else np.zeros(0, np.uint32)
        key = np.concatenate(keys) if keys else np.zeros(0, U)
        df = np.concatenate(dfs) if dfs else np.zeros(0, np.uint8)
        have = np.bincount(row, minlength=len(n))
        lives = (n > 0) & valid & (den * have >= num * n)
        keep = np.flatnonzero(lives[row])
        keep = keep[np.lexsort((key[keep], df[keep], row[keep]))]
        first = np.searchsorted(row[keep], np.arange(len(n) + 1))
        key = key[keep]
        held = [key[first[k] : first[k + 1]].tobytes() if lives[k] else None for k in range(len(n))]
        return pa.table(
            [pa.array(number, mask=~valid), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), pa.array(held, pa.binary())],
            names=["doc_id", "n_shingles", "f1", "f2", "keys"],
        )

    return run


def _prefixes(num: int, den: int):
    """Index entries of each document: its rarest shared shingles, one more than it may lack."""

    def run(batches):
        for batch in batches:
            ids, n = np.array(batch.column(0)), np.array(batch.column(1))
            keys = [np.frombuffer(x, np.int64) for x in batch.column(2).to_pylist()]
            if not len(ids):
                continue
            part = [k[: len(k) + num * m // -den + 1] for k, m in zip(keys, n.tolist())]
            size = [len(p) for p in part]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(part)), pa.array(np.repeat(ids, size))], names=["key", "doc_id"])

    return run


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    label = np.full(len(linked), -1)
    for start in range(len(linked)):
        if label[start] >= 0:
            continue
        label[start], todo = start, np.array([start])
        while len(todo):
            near = np.flatnonzero(linked[todo].any(0) & (label < 0))
            label[near] = start
            todo = near
    return label


def overlaps(left: list[np.ndarray], right: list[np.ndarray], slice_columns: int = 4096) -> np.ndarray:
    """Counts of common entries, accumulated over slices of the shingles that both sides have."""
    l_all, r_all = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(l_all, r_all)
    out = np.zeros((len(left), len(right)), np.float32)
    where = []
    for rows, values in ((left, l_all), (right, r_all)):
        at = np.searchsorted(columns, values)
        ok = (at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == values) if len(columns) else np.zeros(len(values), bool)
        where.append((np.repeat(np.arange(len(rows)), [len(r) for r in rows])[ok], at[ok]))
    for c in range(0, len(columns), slice_columns):
        parts = []
        for (row, at), n in zip(where, out.shape):
            inside = (at >= c) & (at < c + slice_columns)
            m = np.zeros((n, min(slice_columns, len(columns) - c)), np.float32)
            m[row[inside], at[inside] - c] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def _products(num: int, den: int):
    """Links within the groups of a task, as spanning forests."""

    def run(table: pa.Table) -> pa.Table:
        groups: dict = {}
        for group, side, doc, n, keys in zip(*(table[c].to_pylist() for c in ("group", "side", "doc_id", "n_shingles", "keys"))):
            groups.setdefault(group, ([], []))[side].append((doc, n, np.frombuffer(keys, np.int64)))
        a, b = [], []
        for left, right in groups.values():
            whole = not right
            other = left if whole else right
            if not left or len(left) + len(right) < 2:
                continue
            o = overlaps([x[2] for x in left], [x[2] for x in other]).astype(np.int64)
            size_l, size_r = (np.array([x[1] for x in s]) for s in (left, other))
            linked = den * o >= num * (size_l[:, None] + size_r[None, :] - o)
            if not whole:
                k = len(left)
                full = np.zeros((k + len(right),) * 2, bool)
                full[:k, k:], full[k:, :k] = linked, linked.T
                linked = full
            docs = [x[0] for x in left] + ([] if whole else [x[0] for x in right])
            for i, r in enumerate(forest(linked)):
                if docs[i] != docs[r]:
                    a.append(docs[i])
                    b.append(docs[r])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _dealt(rows: DataFrame, clusters: DataFrame, block: int, spread: int) -> DataFrame:
    """rows for the products: a small cluster is one group; a large one is cut by size class and salt into pairs."""
    sized = clusters.join(rows.select(F.col("doc_id").alias("node"), "n_shingles"), "node").withColumn(
        "class", F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(4 / 3)) + 1e-9)
    )
    total = sized.groupBy("component").agg(F.count("*").alias("total"))
    per = sized.groupBy("component", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("salts"))
    # of a large cluster, each class also meets the next larger one: sizes within 3:4 differ by one class at most
    above = per.select("component", (F.col("class") - 1).alias("class"), F.col("salts").alias("up"))
    below = per.select("component", (F.col("class") + 1).alias("class"), F.col("salts").alias("down"))
    plan = per.join(total, "component").join(above, ["component", "class"], "left").join(below, ["component", "class"], "left")
    placed = spread_join(sized, plan, ["component", "class"], "node", spread).withColumn("salt", F.expr("cast(pmod(xxhash64(node), salts) as int)"))
    name = "concat_ws(':', component, {}, {}, {}, {})"
    meets = f"""case when total <= {block} then array(struct(string(component) as group, 0 as side)) else concat(
        transform(sequence(0, salts - 1), t -> struct({name.format('class', 'least(salt, t)', 'class', 'greatest(salt, t)')} as group, int(salt > t) as side)),
        case when up is null then array() else transform(sequence(0, up - 1), t -> struct({name.format('class', 'salt', 'class + 1', 't')} as group, 0 as side)) end,
        case when down is null then array() else transform(sequence(0, down - 1), t -> struct({name.format('class - 1', 't', 'class', 'salt')} as group, 1 as side)) end) end"""
    grouped = placed.select("node", F.explode(F.expr(meets)).alias("x")).select(F.col("node").alias("doc_id"), "x.group", "x.side")
    return grouped.join(rows.select("doc_id", "n_shingles", "keys"), "doc_id")


def components(docs: DataFrame, num: int = 75, den: int = 100, width: int = 5, block: int = 256) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ after A-Z become lower case; a set is the distinct runs of `width` words, or the
    whole sequence if shorter. Sets link when den * intersection >= num * union. Null and empty texts, and those
    without words, have size 0 and link with nothing; a row without doc_id links with nothing and has a null
    component. Rows that repeat a doc_id are one node, each with its own size. Other columns are ignored; an empty
    table gives none.
    """
    buckets = int(max(8, text_bytes(docs) // (4 << 20)))
    sent = docs.select("doc_id", "text").mapInArrow(lean(_cut(buckets, width)), _SENT)
    rows = materialised(
        sent.groupBy("dest").applyInArrow(lean(_shared), _SENT).groupBy("block").applyInArrow(lean(_gathered(num, den)), _ROWS)
    )
    alive = rows.where("keys is not null")
    same = alive.groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    salts = salts_for(rows.count())
    copies = spread_join(alive.select("doc_id", "f1", "f2", "n_shingles"), same.where("copies > 1").drop("copies"), ["f1", "f2", "n_shingles"], "doc_id", salts)
    copies = copies.select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    reps = alive.join(same.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "n_shingles", "keys")
    index = reps.mapInArrow(lean(_prefixes(num, den)), "key long, doc_id long")
    hubs = index.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub < last")
    stars = index.join(hubs.select("key", "hub"), "key").where("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b"))
    clusters = materialised(connected_components(stars))
    dealt = _dealt(reps, clusters, block, salts).withColumn("task", F.expr(f"case when instr(`group`, ':') > 0 then `group` else string(pmod(xxhash64(`group`), {4 * buckets})) end"))
    links = dealt.groupBy("task").applyInArrow(lean(_products(num, den)), "a long, b long")
    found = connected_components(links.unionByName(copies))
    return rows.join(found, rows.doc_id == found.node, "left").select(
        rows.doc_id, "n_shingles", F.coalesce("component", rows.doc_id).alias("component_id")
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each group of docs that links join, that of the smallest doc_id (null is largest).

    Rows are judged one by one, by a hash of doc_id and text: of rows equal in both one stays, different texts under one
    doc_id are two documents, and rows without doc_id link by their text. Texts without words link with nothing, so
    they all stay, but for repeats of one doc_id and text.
    """
    keyed = docs.withColumn("_row", F.xxhash64("doc_id", F.col("text").cast("binary"), F.col("doc_id").isNull(), F.col("text").isNull()))
    bare = F.col("doc_id").isNull() & F.expr("coalesce(not text rlike '[^\\\\x20\\\\x09-\\\\x0D]', true)")
    twice = materialised(keyed.where(~bare).groupBy("_row").count().where("count > 1").select("_row"))
    if not twice.isEmpty():
        repeats = keyed.join(twice, "_row", "left_semi").dropDuplicates(["_row"])
        keyed = keyed.join(twice, "_row", "left_anti").unionByName(repeats)
    found = components(keyed.select(F.col("_row").alias("doc_id"), "text"), **options)
    linked = materialised(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_row"), F.col("component_id").alias("to")).distinct())
    linked = linked.unionByName(linked.select(F.col("to").alias("_row"), "to").distinct())
    placed = linked.join(keyed.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row").alias("place")), "_row")
    first = placed.groupBy("to").agg(F.min("place").alias("kept"))
    lost = spread_join(placed, first, ["to"], "_row", salts_for(linked.count())).where("_row <> kept._row").select("_row")
    return keyed.join(lost, "_row", "left_anti").drop("_row")
