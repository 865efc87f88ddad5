"""Embedding near-duplicates by a robust-pruned flat graph.

Centres are a bounded sample of rows of each label; of centres nearer to each other than two linked pairs one stays, so
a group of close rows does not fall apart into many shards. A vector is at home in the shard of its nearest centre c
and a guest in that of any other centre d where a vector that links with it can be at home: such a vector lies beyond
the plane between c and d, so the vector's distance v(c - d) / |c - d| from that plane is at most the sine of the
bound's angle. Of the shards of two homes one takes the other's guests, so a pair that links meets in one shard, once.
A shard's homes and guests are cut by a hash into parts of at most `part_rows`; a group is one part of homes with
itself and the first guests, or with another part. Among the homes of one part a flat graph is built: the exact nearest
of each row and some far ones, pruned robustly (a candidate goes when a kept neighbour is nearer to it, by alpha, than
the row). Every row searches it greedily from the medoid and from its own node, and expands the range: any node within
the bound is expanded until none is left. Found pairs are verified by cosine in double precision, and an audit of all
rows of the part adds what the search missed; parts that meet are compared by products in blocks. Groups return counts per row and a spanning forest, never the pairs, and the
components follow from the forests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, materialised
from .ann_forest import matrix, valid_vectors


def robust_prune(x: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each row's candidate pool (rows x c, nearest first), at most `degree` diverse ones; -1 fills up."""
    x = x.astype(np.float32)
    out = np.full((len(pool), degree), -1, np.int64)
    for a in range(0, len(pool), 256):
        rows = pool[a : a + 256]
        v = x[rows]
        near = 1 - np.matmul(v, x[a : a + 256, :, None])[:, :, 0]
        between = 1 - np.matmul(v, v.transpose(0, 2, 1))
        alive = rows != np.arange(a, a + len(rows))[:, None]
        at = np.arange(len(rows))
        for k in range(degree):
            d = np.where(alive, near, np.inf)
            best = d.argmin(1)
            ok = np.isfinite(d[at, best])
            out[a : a + 256, k] = np.where(ok, rows[at, best], -1)
            alive &= alpha * between[at, best] > near
            alive[at, best] = False
    return out


def build(x: np.ndarray, degree: int = 16, pool: int = 48, alpha: float = 1.2, seed: int = 11) -> np.ndarray:
    """Adjacency lists (rows x degree, -1 fills up) of the pruned graph over unit vectors."""
    n = len(x)
    near = min(n, pool)
    ids = np.empty((n, near), np.int64)
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        part = np.argpartition(-s, near - 1, axis=1)[:, :near]
        ids[a : a + 512] = np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)
    far = np.random.default_rng(seed).integers(0, n, (n, min(n, 16)))
    return robust_prune(x, np.hstack([ids, far]), degree, alpha)


def dots(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Inner products of x's rows a and y's rows b, `step` pairs at a time."""
    out = np.empty(len(a), np.result_type(x, y))
    for k in range(0, len(a), step):
        out[k : k + step] = np.einsum("ij,ij->i", x[a[k : k + step]], y[b[k : k + step]])
    return out


def range_search(x: np.ndarray, near: list[np.ndarray] | np.ndarray, bound: float, beam: int = 12, block: int = 512, edges: int = 1 << 21):
    """(row, found row) for pairs within the bound that greedy search from the medoid and the row itself reaches.

    A round expands every open node within the range at once, or, where a row has none, those among its best `beam`;
    it follows `edges` edges at a time, so a large group of close rows costs rounds of its diameter, not of its size.
    """
    n = len(x)
    # every edge is taken both ways: pruning leaves only the way to the hub of close copies
    tail = np.repeat(np.arange(n), [len(v) for v in near])
    head = np.concatenate(near).astype(np.int64) if len(tail) else tail
    both = np.unique(np.concatenate([tail * n + head, head * n + tail]))
    tail, head = both // n, both % n
    first = np.searchsorted(tail, np.arange(n + 1))
    degree = np.diff(first)
    medoid = int((x @ x.mean(0)).argmax())
    left, right = [], []
    for a in range(0, n, block):
        q = np.arange(a, min(n, a + block))
        score = np.full((len(q), n), -np.inf, np.float32)
        at = np.arange(len(q))
        for start in (np.full(len(q), medoid), q):
            score[at, start] = (x[q] * x[start]).sum(1)
        done = np.zeros((len(q), n), bool)
        live = at
        while len(live):
            own = score[live]
            opened = np.isfinite(own) & ~done[live]
            pick = opened & (own >= bound - 1e-6)
            idle = np.flatnonzero(~pick.any(1))
            if len(idle):
                floor = np.partition(own[idle], n - min(n, beam), axis=1)[:, n - min(n, beam)]
                pick[idle] = opened[idle] & (own[idle] >= floor[:, None])
            go = pick.any(1)
            live, pick = live[go], pick[go]
            if not len(live):
                break
            done[live] |= pick
            who, node = np.nonzero(pick)
            reached = np.zeros((len(live), n), bool)
            ends = np.cumsum(degree[node])
            k = 0
            while k < len(node):
                stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + edges, "right")))
                many = degree[node[k:stop]]
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                reached[np.repeat(who[k:stop], many), head[np.repeat(first[node[k:stop]], many) + within]] = True
                k = stop
            r, c = np.nonzero(reached & ~np.isfinite(score[live]))
            score[live[r], c] = dots(x, x, q[live[r]], c)
        r, c = np.nonzero(score >= bound - 1e-4)
        left.append(q[r])
        right.append(c)
    return np.concatenate(left), np.concatenate(right)


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest that is reachable over the pairs (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _unit(table: pa.Table) -> np.ndarray:
    x = matrix(table["embedding"])
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares of tiny nor of huge components are lost
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def thinned(c: np.ndarray, near: float) -> np.ndarray:
    """Rows of c (unit vectors), in order, without those whose cosine with one that stays is at least `near`."""
    kept, held = [], np.empty_like(c)
    for i, v in enumerate(c):
        if not kept or (held[: len(kept)] @ v).max() < near:
            held[len(kept)] = v
            kept.append(i)
    return np.array(kept, np.int64)


def homes_and_guests(x: np.ndarray, c: np.ndarray, bound: float, block: int = 256):
    """For each row of x its nearest of the centres c, and the list of those it is a guest of.

    Rows whose cosine is at least the bound share a centre, as two homes or as a home and a guest, and only one.
    """
    reach = np.sqrt(1 - bound * bound) if bound > 0 else np.inf
    homes, guests = np.empty(len(x), np.int64), [None] * len(x)
    every = np.arange(len(c))
    for a in range(0, len(x), block):
        s = x[a : a + block] @ c.T
        home = homes[a : a + block] = s.argmax(1)
        for h in np.unique(home):
            rows = np.flatnonzero(home == h)
            apart = np.sqrt(np.maximum(0, ((c - c[h]) ** 2).sum(1)))
            takes = ((every < h) == ((every + h) % 2 == 0)) & (every != h)  # one of two homes, in turn the first and second
            near = (s[rows, h][:, None] - s[rows] <= (reach * apart if np.isfinite(reach) else np.inf) + 1e-9) & takes
            for r, m in zip(rows, near):
                guests[a + r] = np.flatnonzero(m)
    return homes, guests


def _assigned(rows: DataFrame, centres: list, bound: float) -> DataFrame:
    held: dict = {}
    for r in centres:
        v = np.array(r["embedding"], float)
        v /= np.abs(v).max()
        held.setdefault((r["label"], len(v)), []).append(v / np.sqrt((v * v).sum()))
    # planes between centres nearer than twice the bound's angle are crossed by most rows of both
    near = 2 * bound * bound - 1 if bound > 0 else -1
    held = {k: np.array(v)[thinned(np.array(v), near)] for k, v in held.items()}

    def run(batches):
        for batch in batches:
            label, size = batch.column(1).to_pylist(), np.array(pa.compute.list_value_length(batch.column(2)))
            home, guests = [None] * len(label), [[] for _ in label]
            kinds: dict = {}
            for i, k in enumerate(zip(label, size.tolist())):
                kinds.setdefault(k, []).append(i)
            for (y, n), at in kinds.items():
                c = held.get((y, n))
                if c is None:
                    for i in at:
                        home[i] = f"{y}:{n}"
                else:
                    own, others = homes_and_guests(_unit(pa.table([batch.column(2).take(pa.array(at))], names=["embedding"])), c, bound)
                    for i, h, g in zip(at, own.tolist(), others):
                        home[i], guests[i] = f"{y}:{n}:{h}", [f"{y}:{n}:{k}" for k in g.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(home, pa.string()), pa.array(guests, pa.list_(pa.string()))], names=["vec_id", "embedding", "home", "guests"]
            )

    kind = rows.schema["embedding"].dataType.simpleString()
    return rows.mapInArrow(run, f"vec_id long, embedding {kind}, home string, guests array<string>")


def _grouped(assigned: DataFrame, part_rows: int) -> DataFrame:
    """A row for each group of a vector, named shard|left part|right part; homes' parts go before guests'.

    The first guests join the group of each part of homes with itself; any other two parts are a group if one is of
    homes. So a home and another home or guest of its shard meet in one group.
    """
    shards = F.expr("explode(concat(array(struct(home as shard, false as guest)), transform(guests, g -> struct(g as shard, true as guest)))) as s")
    spread = assigned.select("vec_id", "embedding", shards).select("vec_id", "embedding", "s.shard", "s.guest")
    parts = assigned.select(shards).groupBy("s.shard").agg(
        F.greatest(F.lit(1), F.ceil(F.sum(F.expr("int(not s.guest)")) / part_rows)).cast("int").alias("homes"),
        F.greatest(F.lit(1), F.ceil(F.sum(F.expr("int(s.guest)")) / part_rows)).cast("int").alias("others"),
    )
    spread = spread.join(F.broadcast(parts.where("homes > 1 or others > 1")), "shard", "left").fillna(1, ["homes", "others"])
    spread = spread.withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), if(guest, others, homes)) as int)"))
    meets = """case when guest then transform(sequence(0, homes - 1), i -> struct(i as l, if(part = 0, i, homes + part - 1) as r)) else concat(
        transform(sequence(0, homes - 1), i -> struct(least(i, part) as l, greatest(i, part) as r)),
        case when others = 1 then array() else transform(sequence(1, others - 1), g -> struct(part as l, homes + g - 1 as r)) end) end"""
    return spread.withColumn("g", F.explode(F.expr(meets))).select(
        "vec_id", "embedding", F.expr("concat_ws('|', shard, g.l, g.r)").alias("group"), F.expr("not guest and part = g.l").alias("left")
    )


def compared(x: np.ndarray, y: np.ndarray, bound: float, step: int = 512):
    """(row of x, row of y) of all pairs whose cosine is at least the bound, by products of `step` rows at a time."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(x) if len(y) else 0, step):
        i, j = np.nonzero(x[a : a + step] @ y.T >= bound)
        left.append(i + a)
        right.append(j)
    return np.concatenate(left), np.concatenate(right)


def audited(x: np.ndarray, a: np.ndarray, b: np.ndarray, bound: float):
    """The pairs (a, b), a < b, of x's rows that are within the bound, and those that the search for them missed.

    The audit's queries are all rows, against all rows, so recall after it is 1 whatever the graph found.
    """
    p, q = compared(x, x, bound)
    ok = dots(x, x, a, b) >= bound
    pair = np.union1d(a[ok] * len(x) + b[ok], p[p < q] * len(x) + q[p < q])
    return pair // len(x), pair % len(x)


def links(
    embeddings: DataFrame, bound: float = 0.98, centre_rows: int = 256, most_centres: int = 16384, part_rows: int = 2048, degree: int = 16
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of embeddings(vec_id, embedding, label).

    Vectors link when their labels are equal and not null and their cosine is at least the bound. Vectors that are
    null, zero or hold null or non-finite components, or another length, link with nothing; a row without vec_id has
    null component and is kept. Rows that repeat an id are one vector, that of the first by content. Other columns
    are ignored.
    """
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    own = embeddings.select("vec_id", F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"))
    rows = valid_vectors(own.where("label is not null")).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("x")).select("vec_id", "x.label", "x.embedding")
    total = rows.count()
    rate = min(1 / centre_rows, most_centres / max(1, total))
    centres = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(rate * (1 << 20))).orderBy("vec_id").limit(2 * most_centres).collect()
    spread = _grouped(materialised(_assigned(rows, centres, bound)), part_rows)

    def find(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.argsort(np.asarray(table["vec_id"]), kind="stable")))
        ids, left = np.asarray(table["vec_id"]), np.asarray(table["left"])
        x = _unit(table)
        i, j = table["group"][0].as_py().rsplit("|", 2)[1:]
        here, there = np.flatnonzero(left), np.flatnonzero(~left)
        a, b = compared(x[here], x[there], bound)
        a, b = here[a], there[b]
        if i == j and len(here) > 1:
            own = x[here]
            near = [r[r >= 0] for r in build(own, degree)]
            p, q = range_search(own, near, bound)
            p, q = np.concatenate([p, q]), np.concatenate([q, p])  # what either end finds counts for both
            pair = np.unique(p[p < q] * len(own) + q[p < q])
            p, q = audited(own, pair // len(own), pair % len(own), bound)
            a, b = np.concatenate([a, here[p]]), np.concatenate([b, here[q]])
        counts = np.bincount(np.concatenate([a, b]), minlength=len(ids))
        root = smallest_linked(len(ids), a, b)
        linked = np.flatnonzero(counts)
        return pa.table(
            [pa.array(ids[linked]), pa.array(counts[linked].astype(np.int64)), pa.array(ids[root[linked]], pa.int64())], names=["vec_id", "n", "to"]
        )

    found = materialised(spread.groupBy("group").applyInArrow(find, "vec_id long, n long, to long"))
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("to").alias("b")))
    out = own.select("vec_id").join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
