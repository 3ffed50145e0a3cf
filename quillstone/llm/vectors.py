"""Most similar vectors for every vector, by additive quantisation.

A vector is approximated by a sum of full-dimensional codewords, one from each of several
residual codebooks; codes are found by beam search and the squared norm of each
approximation is stored with them. The first codebooks also name a vector's cell. How many
cells a query searches is measured: the exact neighbours of a sample of queries tell in which of
their cells they lie, and the fewest cells that hold the wanted share are taken.

Cells are gathered in shards of bounded size (a cell beyond it is cut into blocks). A query goes,
as one byte for each element, to the shards that hold its cells; queries of one shard are
dealt to several tasks, so that neither side of a task grows with the data. There members are scored
by sums of lookup-table entries, and the shortlist by the products of the shipped bytes. What may
still be among the k best is compared exactly, with the vectors themselves. Exact copies of a
vector are encoded once and expanded at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.vec import dot, unit
from quillstone.operators.retrieval import topk
from quillstone.session import discard, materialize, release, tasks

SHARD_ROWS = 8192
QUERY_ROWS = 16384  # queries of a shard in one task
BATCH = 512  # queries scored together
PIECE = 256  # members scored together
PASS_VISITS, PASS_LEAST = 6, 1 << 20  # copies of queries sent at once: for each row of the table, and in all
ENTRIES = 1 << 22  # elements of a matrix that is worked on at once
SPARE = 4  # with a threshold, so many times the cells that hold the wanted share of the sample's neighbours
LEAST_WANTED = 64  # wanted neighbours in the sample that can tell how many cells hold them


@dataclass
class AdditiveQuantizer:
    """Residual codebooks of full dimension: books[m] is (K_m, d), float32."""

    books: list[np.ndarray]
    cell_books: int = 1
    beam: int = 4
    norms: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.norms = [(b * b).sum(1) for b in self.books]

    @property
    def cells(self) -> int:
        return math.prod(len(b) for b in self.books[: self.cell_books])

    @classmethod
    def fit(cls, sample: np.ndarray, cell_sizes: list[int], n_books: int, k: int, beam: int = 4, iterations: int = 5, seed: int = 7) -> AdditiveQuantizer:
        """Residual k-means over the sample, a book at a time."""
        rng = np.random.default_rng(seed)
        left, books = sample.astype(np.float32), []
        for size in [*cell_sizes, *[k] * (n_books - len(cell_sizes))]:
            size = max(1, min(size, len(left)))
            book = _kmeans(left, size, iterations, rng)
            books.append(book)
            left = left - book[_nearest(left, book)]
        return cls(books, len(cell_sizes), beam)

    def encode(self, x: np.ndarray, books: int | None = None, beam: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Codes (n, beam, books), the best first, and |x - sum|^2 - |x|^2 of each."""
        n, beam = len(x), beam or self.beam
        left = x[:, None, :]  # what each beam has still to approximate
        start = (x * x).sum(1)[:, None]
        err, codes = start, np.zeros((n, 1, 0), np.int32)
        for m, book in enumerate(self.books[:books]):
            cost = (err[:, :, None] + self.norms[m] - 2 * (left.reshape(-1, x.shape[1]) @ book.T).reshape(n, -1, len(book))).reshape(n, -1)
            top, err = _smallest(cost, min(beam, cost.shape[1]))
            parent, code = top // len(book), (top % len(book)).astype(np.int32)
            if m + 1 < len(self.books[:books]):
                left = np.take_along_axis(left, parent[:, :, None], 1) - book[code]
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), code[:, :, None]], 2)
        return codes, err - start

    def nearest_cells(self, x: np.ndarray, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cells of each row (n, n_cells), the best first, and their |x - centre|^2 - |x|^2."""
        first, *more = (len(b) for b in self.books[: self.cell_books])
        step = max(1, ENTRIES // max(first, min(n_cells, first) * max(x.shape[1], *more) if more else 0))  # beams of many cells are wide
        parts = [self.encode(x[i : i + step], self.cell_books, n_cells) for i in range(0, max(1, len(x)), step)]
        return self.cell_of(np.concatenate([c for c, _ in parts])), np.concatenate([e for _, e in parts])

    def approximate(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, m]] for m, b in enumerate(self.books))

    def centres(self, cells: np.ndarray) -> np.ndarray:
        out, rest = np.zeros((len(cells), self.books[0].shape[1]), np.float32), cells.copy()
        for j in range(self.cell_books - 1, -1, -1):
            out += self.books[j][rest % len(self.books[j])]
            rest //= len(self.books[j])
        return out

    def cell_of(self, codes: np.ndarray) -> np.ndarray:
        cell = np.zeros(codes.shape[:-1], np.int64)
        for j in range(self.cell_books):
            cell = cell * len(self.books[j]) + codes[..., j]
        return cell


def _smallest(cost: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the `keep` smallest of each row are, ascending, and what they are; `cost` is overwritten."""
    if keep > 8:
        top = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < cost.shape[1] else np.broadcast_to(np.arange(keep), (len(cost), keep))
        value = np.take_along_axis(cost, top, 1)
        order = np.argsort(value, axis=1, kind="stable")
        return np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    top, value, row = np.empty((len(cost), keep), np.int64), np.empty((len(cost), keep), cost.dtype), np.arange(len(cost))
    for j in range(keep):
        top[:, j] = cost.argmin(1)
        value[:, j] = cost[row, top[:, j]]
        cost[row, top[:, j]] = np.inf
    return top, value


def _nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    block = max(64, ENTRIES // len(book))
    half = 0.5 * (book * book).sum(1)
    return np.concatenate([np.argmax(x[i : i + block] @ book.T - half, 1) for i in range(0, len(x), block)]) if len(x) else np.zeros(0, np.int64)


def _kmeans(x: np.ndarray, k: int, iterations: int, rng: np.random.Generator) -> np.ndarray:
    book = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(iterations):
        near = _nearest(x, book)
        count = np.bincount(near, minlength=k)
        order = np.argsort(near, kind="stable")
        filled = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[filled]
        book[filled] = np.add.reduceat(x[order], starts, axis=0) / count[filled, None]
        empty = np.flatnonzero(count == 0)
        if len(empty):  # an empty codeword moves beside a member of a full cell
            book[empty] = x[rng.choice(len(x), len(empty))] * np.float32(1.0001)
    return book


def _units(vecs: pd.Series) -> np.ndarray:
    out = np.stack(vecs.to_numpy()).astype(np.float32, copy=False)
    for i in range(0, len(out), 8192):
        raw = out[i : i + 8192].astype(np.float64)
        out[i : i + 8192] = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    return out


def _to_bytes(x: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Rows as one signed byte for each element, and the scale of each row."""
    scale = np.abs(x).max(1) / 127
    return [r.tobytes() for r in np.rint(x / scale[:, None]).astype(np.int8)], scale.astype(np.float32)


def _from_bytes(col: pd.Series, scale: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_list()), np.int8).reshape(len(col), -1) * scale.to_numpy(np.float32)[:, None]


def _ranges(lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """lo[i], ..., lo[i] + count[i] - 1 for each i, and i."""
    which = np.repeat(np.arange(len(lo)), count)
    return np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count), which


def unit_vectors(df: DataFrame, id_col: str, vec_col: str, dim: int | None = None) -> DataFrame:
    """(id, vec): vectors of the wanted dimension (default: the most frequent, of equally
    frequent ones the larger). Null ids, null, zero or non-finite vectors and vectors with a
    null element are left out. Of repeated ids the smallest vector is kept."""
    v = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    if dim is None:
        row = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = row["d"] if row else 0
    usable = "size(vec) = {0} AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf')) AND exists(vec, x -> x <> 0)".format(dim)
    v = v.where(usable)
    repeated = materialize(v.groupBy("id").count().where("count > 1").select("id"), "repeated-ids")
    if repeated.isEmpty():
        return v  # vectors need no shuffle
    return v.join(repeated, "id", "left_anti").unionByName(v.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("vec").alias("vec")))


def fit_quantizer(reps: DataFrame, n: int, n_books: int, book_size: int, cell_rows: int, sample_rows: int) -> AdditiveQuantizer:
    """Codebooks of a sample of `reps` (rid, vec): about `sample_rows` rows, chosen by a hash of the id."""
    part = max(1, math.ceil(n / sample_rows))
    rows = reps.where(F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(part)) == 0).select("rid", "vec").toPandas().sort_values("rid")
    if rows.empty:
        rows = reps.limit(1).toPandas()
    x = _units(rows["vec"])[: 2 * sample_rows]
    want = max(1, n // cell_rows)
    top = max(1, min(len(x) // 8, 4096))
    cell_sizes = [min(want, top)] if want <= 4 * top else [top, max(2, min(book_size, want // top))]
    return AdditiveQuantizer.fit(x, cell_sizes, max(n_books, len(cell_sizes) + 1), book_size)


def measured_probes(coded: DataFrame, shared, n: int, k: int, target_recall: float, sample_queries: int, low: float = -1.0) -> int:
    """The fewest nearest cells that hold `target_recall` of the k nearest rows of a sample of queries.

    Where only similarities of `low` or more are wanted and the sample has enough of them, these count alone,
    and SPARE times as many cells are searched.

    coded: (rid, q, scale, cell). The sample (about `sample_queries` rows, by a hash of the id) is compared
    with all rows; each task passes on its k best for each query, so that little is shuffled.
    """
    part = max(1, math.ceil(n / sample_queries))
    rows = coded.where(F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(part)) == 0).select("rid", "q", "scale").toPandas().sort_values("rid")[: 2 * sample_queries]
    if len(rows) < 2:
        return shared.value.cells
    ids, x = rows["rid"].to_numpy(np.int64), _from_bytes(rows["q"], rows["scale"])
    asked = coded.sparkSession.sparkContext.broadcast((ids, x))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, x = asked.value
        best, cells = np.full((k, len(ids)), -2, np.float32), np.full((k, len(ids)), -1, np.int64)
        for b in batches:
            for i in range(0, len(b), 4096):
                c = b.iloc[i : i + 4096]
                s = _from_bytes(c["q"], c["scale"]) @ x.T
                s[c["rid"].to_numpy(np.int64)[:, None] == ids[None, :]] = -2
                s = np.concatenate([best, s])
                of = np.concatenate([cells, np.broadcast_to(c["cell"].to_numpy(np.int64)[:, None], (len(c), len(ids)))])
                top = np.argpartition(-s, k - 1, axis=0)[:k]
                best, cells = np.take_along_axis(s, top, 0), np.take_along_axis(of, top, 0)
        at, who = np.nonzero(cells >= 0)
        yield pd.DataFrame({"rid": ids[who], "cell": cells[at, who], "s": best[at, who].astype(np.float64)})

    near = coded.select("rid", "q", "scale", "cell").mapInPandas(nearest, "rid long, cell long, s double")
    w = Window.partitionBy("rid").orderBy(F.desc("s"), "cell")
    near = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).toPandas()  # k rows for each query of the sample
    spare, wanted = 1, near[near["s"] >= low - ROUNDING]
    if low > -1 and len(wanted) >= LEAST_WANTED:
        near, spare = wanted, SPARE
    return needed_cells(shared.value, x, np.searchsorted(ids, near["rid"].to_numpy(np.int64)), near["cell"].to_numpy(np.int64), target_recall, spare)


def needed_cells(aq: AdditiveQuantizer, x: np.ndarray, row: np.ndarray, cell: np.ndarray, share: float, spare: int = 1) -> int:
    """`spare` times the fewest nearest cells of x[row[i]] that hold the wanted share of all cell[i]; a few rows are looked at at once."""
    order, width = np.argsort(row, kind="stable"), 16
    row, cell = row[order], cell[order]
    while True:
        width = min(width, aq.cells)
        step, ranks = max(1, ENTRIES // (8 * width)), []
        for i in range(0, len(x), step):
            a, b = np.searchsorted(row, [i, i + step])
            if b > a:
                hit = aq.nearest_cells(x[i : i + step], width)[0][row[a:b] - i] == cell[a:b, None]
                ranks.append(np.where(hit.any(1), hit.argmax(1), width))
        rank = np.sort(np.concatenate(ranks))
        need = rank[min(len(rank) - 1, math.ceil(share * len(rank)) - 1)] + 1
        if need <= width or width == aq.cells:
            return int(min(spare * need, aq.cells))
        width *= 4


def _near_order(x: np.ndarray) -> np.ndarray:
    """An order of the rows in which near ones are close: halves along the direction in which they differ most."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        part = todo.pop()
        if len(part) <= 2:
            out.append(part)
            continue
        y = x[part] - x[part].mean(0)
        part = part[np.argsort(y @ np.linalg.eigh(y.T @ y)[1][:, -1], kind="stable")]
        todo += [part[len(part) // 2 :], part[: len(part) // 2]]
    return np.concatenate(out)


def knn(
    df: DataFrame,
    id_col: str = "sentence_id",
    vec_col: str = "embeddings",
    k: int = 5,
    query_filter: str | None = None,
    min_similarity: float = -1.0,
    target_recall: float = 0.98,
    shortlist: int = 160,
    n_books: int = 12,
    book_size: int = 256,
    cell_rows: int = 128,
    sample_rows: int = 32768,
    sample_queries: int = 512,
    dim: int | None = None,
) -> DataFrame:
    """(query_id, neighbor_id, rank, similarity): for each query row its k most similar other
    rows by cosine, ties to the smaller id, of those with at least `min_similarity`.

    Queries are all rows, or those that satisfy `query_filter` (an SQL condition on `id`);
    all rows are searched. The codebooks are fitted on about `sample_rows` rows (chosen by
    a hash of the id); every row is encoded. Each query searches the cells that hold `target_recall` of
    the neighbours of `sample_queries` rows (see `measured_probes`); of each shard it
    visits, `shortlist` members are compared by their bytes, and what may be among the k best by the vectors
    themselves. Which vectors are left out is said in `unit_vectors`; an empty input, or one
    without usable vectors, gives no rows.
    """
    spark = df.sparkSession
    schema = "query_id long, neighbor_id long, rank int, similarity double"
    v = unit_vectors(df, id_col, vec_col, dim)
    v = v.withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64(F.lit(17), F.reverse("vec"))})
    asked = F.coalesce(F.bool_or(F.expr(query_filter)), F.lit(False)) if query_filter else F.lit(True)  # a class asks if any of its ids does
    reps = materialize(v.groupBy("h1", "h2").agg(F.min("id").alias("rid"), F.count(F.lit(1)).alias("copies"), asked.alias("asked")), "vector-classes")
    n = reps.count()
    if n == 0:
        return spark.createDataFrame([], schema)
    vecs = v.select(F.col("id").alias("rid"), "vec")  # read where they are: no copy of all vectors is written
    v = materialize(v.select("id", "h1", "h2"), "vector-ids")
    own = reps.select("rid", "asked").join(vecs, "rid")
    aq = fit_quantizer(own, n, n_books, book_size, cell_rows, sample_rows)
    shared = spark.sparkContext.broadcast(aq)  # at most (4096 + n_books * book_size) codewords

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aq = shared.value
        step = max(16, (1 << 20) // (aq.beam * max(len(b) for b in aq.books)))
        for b in batches:
            for i in range(0, len(b), step):
                part = b.iloc[i : i + step]
                x = _units(part["vec"])
                codes = aq.encode(x)[0][:, 0]
                approx = aq.approximate(codes)
                q, scale = _to_bytes(x)
                norm = (approx * approx).sum(1)
                yield pd.DataFrame({"rid": part["rid"].to_numpy(), "q": q, "scale": scale, "codes": [r.tobytes() for r in codes.astype(np.int16)], "norm": norm, "cell": aq.cell_of(codes), "asked": part["asked"].to_numpy()})

    coded = own.select("rid", "vec", "asked").repartition(max(tasks(spark), n // 16384)).mapInPandas(encode, "rid long, q binary, scale float, codes binary, norm float, cell long, asked boolean")
    coded = materialize(coded, "vector-codes")
    low = float(min_similarity)
    probes = measured_probes(coded, shared, n, k, target_recall, sample_queries, low)
    release(spark)

    # shards: cells, near ones together, until one is full; a cell beyond the bound has shards of its own. All tables are bounded by the codebooks.
    first, blocks, n_shards, room = np.full(aq.cells, -1, np.int64), np.ones(aq.cells, np.int64), 0, 0
    found = coded.groupBy("cell").count().toPandas()
    members = np.zeros(aq.cells, np.int64)
    members[found["cell"]] = found["count"]
    for cell in np.arange(aq.cells).reshape(len(aq.books[0]), -1)[_near_order(aq.books[0])].ravel():
        if members[cell] == 0:
            continue
        if members[cell] > SHARD_ROWS:
            blocks[cell] = math.ceil(members[cell] / SHARD_ROWS)
            first[cell], n_shards, room = n_shards, n_shards + blocks[cell], 0
            continue
        if members[cell] > room:
            n_shards, room = n_shards + 1, SHARD_ROWS
        first[cell] = n_shards - 1
        room -= members[cell]
    # lookup tables cost each visit to a shard a product with each codeword: where fewer members are wanted there, their bytes are compared at once
    direct = low > -1 and probes * n / len(found) <= min(probes, n_shards) * sum(len(b) for b in aq.books[aq.cell_books :])
    share = spark.sparkContext.broadcast(np.minimum(1.0, members / blocks / SHARD_ROWS))
    plan = spark.sparkContext.broadcast((first, blocks))

    def visits(q: pd.Series, scale: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard) for each shard that a row's cells are in; each row's distance to the last of its cells, and the nearest; the work in each shard."""
        aq, (first, blocks) = shared.value, plan.value
        cells, err = aq.nearest_cells(_from_bytes(q, scale), probes)
        home = cells[:, 0]
        row, cell = np.repeat(np.arange(len(cells)), cells.shape[1]), cells.ravel()
        row, cell = row[first[cell] >= 0], cell[first[cell] >= 0]
        shard, which = _ranges(first[cell], blocks[cell])
        both = np.unique(row[which] * n_shards + shard)
        work = np.bincount(shard, share.value[cell[which]] if direct else None, minlength=n_shards)
        return both // n_shards, both % n_shards, err[:, -1], home, work if direct else np.bincount(both % n_shards, minlength=n_shards)

    step = max(64, (1 << 22) // max(len(aq.books[0]), probes * (book_size if aq.cell_books > 1 else 1)))

    def count_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, work = np.zeros(n_shards, np.int64), np.zeros(n_shards)
        for b in batches:
            for i in range(0, len(b), step):
                _, shard, _, _, more = visits(b["q"].iloc[i : i + step], b["scale"].iloc[i : i + step])
                n += np.bincount(shard, minlength=n_shards)
                work += more
        yield pd.DataFrame({"shard": np.flatnonzero(n), "visits": n[n > 0], "work": work[n > 0]})

    asking = coded.where("asked").select("rid", "q", "scale")
    visited = asking.mapInPandas(count_visits, "shard long, visits long, work double").groupBy("shard").agg(F.sum("visits").alias("visits"), F.sum("work").alias("work")).toPandas()
    passes = max(1, math.ceil(visited["visits"].sum() / max(PASS_LEAST, PASS_VISITS * n)))
    deals = np.ones(n_shards, np.int64)  # tasks that the queries of a shard are dealt to, in a pass
    deals[visited["shard"]] = np.ceil(visited["work"] / passes / QUERY_ROWS)
    dealt, before = spark.sparkContext.broadcast(deals), spark.sparkContext.broadcast(np.cumsum(deals) - deals)
    columns = ["slot", "shard", "deal", "asks", "rid", "q", "scale", "codes", "norm", "cell"]
    shape = "slot int, shard long, deal long, asks boolean, rid long, q binary, scale float, codes binary, norm float, cell long"

    def send_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, blocks = plan.value
        for b in batches:
            cell, rid = b["cell"].to_numpy(np.int64), b["rid"].to_numpy(np.int64)
            shard = first[cell] + (rid * 40503 % 65537) % blocks[cell]
            deal, row = _ranges(np.zeros(len(b), np.int64), dealt.value[shard])
            yield b.iloc[row].assign(slot=before.value[shard[row]] + deal, shard=shard[row], deal=deal, asks=False)[columns]

    def send_queries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), step):
                c = b.iloc[i : i + step]
                row, shard, reach, home, _ = visits(c["q"], c["scale"])
                deal = (c["rid"].to_numpy(np.int64)[row] * 2654435761 >> 7) % dealt.value[shard]
                yield c.iloc[row].assign(slot=before.value[shard] + deal, shard=shard, deal=deal, asks=True, codes=None, norm=reach[row], cell=0 if direct else home[row])[columns]

    both = low > -1 and not query_filter  # few pairs are similar enough: what one side finds, both have

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Members of a shard are held, its queries stream past."""
        held, key, index = [], None, None
        for b in batches:
            change = np.flatnonzero(np.diff(b["shard"].to_numpy()) | np.diff(b["deal"].to_numpy()) | np.diff(b["asks"].to_numpy().astype(int))) + 1
            for lo, hi in zip([0, *change], [*change, len(b)]):
                c = b.iloc[lo:hi]
                if (now := (c["shard"].iloc[0], c["deal"].iloc[0])) != key:
                    held, key, index = [], now, None
                if not c["asks"].iloc[0]:
                    held.append(c)
                elif held:
                    index = index or _Shard(pd.concat(held), shared.value)
                    for i in range(0, len(c), BATCH * (16 if direct else 1)):
                        yield index.compare(c.iloc[i : i + BATCH * 16], k, low, both) if direct else index.search(c.iloc[i : i + BATCH], k, shortlist, low, both)

    sent = coded.select("rid", "q", "scale", "codes", "norm", "cell").mapInPandas(send_members, shape)
    nears = []
    for i in range(passes):  # a share of the queries at once, so that their copies take bounded room
        some = asking.where(F.pmod(F.xxhash64("rid", F.lit(23)), F.lit(passes)) == i) if passes > 1 else asking
        # every (shard, deal) is about as much work as any other, and gets a partition of its own
        routed = sent.unionByName(some.mapInPandas(send_queries, shape)).repartitionById(int(deals.sum()), "slot").drop("slot")
        routed = routed.sortWithinPartitions("shard", "deal", "asks", "cell")  # queries of a cell search much the same cells; work, not bytes, decides
        nears.append(routed.mapInPandas(search, "query_rid long, rid long, s float"))
        if passes > 1:
            nears[-1] = materialize(nears[-1], "near-in-shards")
            release(spark)
    near = reduce(DataFrame.unionByName, nears)
    if both:
        near = near.repartition("query_rid").groupBy("query_rid", "rid").agg(F.max("s").alias("s"))  # a pair may be found from both sides
    # the k best of all shards by their bytes, and what rounding may hide behind them; then exactly
    w = Window.partitionBy("query_rid").orderBy(F.desc("s"), "rid")
    near = near.withColumn("r", F.row_number().over(w)).withColumn("last", F.min(F.when(F.col("r") <= k, F.col("s"))).over(Window.partitionBy("query_rid")))
    near = materialize(near.where(F.col("s") >= F.col("last") - 2 * ROUNDING).select("query_rid", "rid"), "near-by-bytes")
    discard(coded)
    release(spark)
    near = near.join(vecs, "rid").withColumnRenamed("vec", "y").join(vecs.select(F.col("rid").alias("query_rid"), F.col("vec").alias("x")), "query_rid")
    x, y = F.col("x"), F.col("y")
    near = near.select("query_rid", "rid", F.least(dot(x, y) / F.sqrt(dot(x, x) * dot(y, y)), F.lit(1.0)).alias("similarity")).where(F.col("similarity") >= low)
    best = Window.partitionBy("query_rid").orderBy(F.desc("similarity"), "rid")
    near = near.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    return _expand(v, reps, materialize(near, "vector-neighbors"), k, query_filter, low)


ROUNDING = 0.005  # of a product of two rows of bytes, several times its standard deviation


class _Shard:
    """The members of a shard by cell, and the search of queries among them."""

    def __init__(self, members: pd.DataFrame, aq: AdditiveQuantizer) -> None:
        m = members.sort_values(["cell", "rid"])
        self.aq, self.ids = aq, m["rid"].to_numpy(np.int64)
        self.x = _from_bytes(m["q"], m["scale"])
        codes = np.frombuffer(b"".join(m["codes"].to_list()), np.int16).reshape(len(m), -1).astype(np.int64)
        self.codes = np.ascontiguousarray(codes.T)
        self.norm = np.sqrt(np.maximum(m["norm"].to_numpy(np.float32), 1e-6))
        self.cells, self.at = np.unique(m["cell"].to_numpy(np.int64), return_index=True)
        self.to = np.append(self.at[1:], len(m))
        self.centres = aq.centres(self.cells)
        self.centre_norms = (self.centres * self.centres).sum(1)
        self.coarse = max(aq.cell_books, -(-2 * len(aq.books) // 3))  # books of the first pass
        self.first, self.all = (self._missing(codes, n) for n in (self.coarse, len(aq.books)))
        self.scores = np.empty((int((self.to - self.at).max()), BATCH), np.float32)
        self.entries = np.empty((PIECE, BATCH), np.float32)

    def _missing(self, codes: np.ndarray, books: int) -> tuple[np.ndarray, np.ndarray]:
        """What the first codewords have of each member along it, and the length of what they leave out."""
        part = sum(b[codes[:, j]] for j, b in enumerate(self.aq.books[:books]))
        along = (self.x * part).sum(1)
        return along, np.sqrt(np.maximum(0, 1 - 2 * along + (part * part).sum(1)))

    def least_score(self, low: float, missing: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """For each member, the least score of a query of cosine `low`: the member's own part of it, less four
        standard deviations of what the codewords leave out across the member."""
        return low * missing[0] - 4 * math.sqrt(1 - low * low) * missing[1] / math.sqrt(self.x.shape[1])

    def _first_pass(self, tables: list[np.ndarray], cell: int) -> np.ndarray:
        """Sums of lookup-table entries of the coarse books, (members of the cell, queries)."""
        a, b, n = self.at[cell], self.to[cell], tables[0].shape[1]
        score = self.scores[: b - a, :n]
        score[:] = sum(tables[m][self.codes[m, a]] for m in range(self.aq.cell_books))  # the same for all members
        for m in range(self.aq.cell_books, self.coarse):
            for i in range(a, b, PIECE):
                to = min(i + PIECE, b)
                score[i - a : to - a] += np.take(tables[m], self.codes[m, i:to], axis=0, out=self.entries[: to - i, :n], mode="clip")
        return score

    def search(self, queries: pd.DataFrame, k: int, shortlist: int, low: float, both: bool) -> pd.DataFrame:
        """The k best members of the queries' cells by bytes, with what may tie with them; `both`: each pair also from the member's side."""
        q, qids, reach = _from_bytes(queries["q"], queries["scale"]), queries["rid"].to_numpy(np.int64), queries["norm"].to_numpy(np.float32)
        n = len(q)
        # a cell that any query of the batch wants is scored for all of them: picking queries costs more than their scores
        wanted = (self.centre_norms[:, None] - 2 * self.centres @ q.T <= reach[None, :] + 1e-4).any(1)
        tables = [np.ascontiguousarray(book @ q.T) for book in self.aq.books]  # (codewords, queries)
        least = self.least_score(min(low, 1.0), self.first) if low > -1 else None
        every = None if low > -1 else np.full((n, len(self.ids)), -np.inf, np.float32)
        rows, cols, firsts = [], [], []
        for c in np.flatnonzero(wanted):
            a, b = self.at[c], self.to[c]
            score = self._first_pass(tables, c)
            if every is not None:
                every[:, a:b] = score.T
                continue
            r, w = np.divmod(np.flatnonzero(score >= least[a:b, None]), n)  # candidates are few
            rows.append(r + a)
            cols.append(w)
            firsts.append(score[r, w])
        if every is None:
            row, col, first = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (rows, cols, firsts))
        else:
            row, col, first = _best_columns(every, 4 * shortlist)
        if not len(row):
            return pd.DataFrame({"query_rid": qids[:0], "rid": self.ids[:0], "s": np.zeros(0, np.float32)})
        for m in range(self.coarse, len(tables)):  # second pass: the other books
            first = first + tables[m][self.codes[m, row], col]
        if every is not None:  # the shortlist by cosine with the approximation
            every[:] = -np.inf
            every[col, row] = first / self.norm[row]
            row, col, _ = _best_columns(every, shortlist)
        else:
            ok = first >= self.least_score(min(low, 1.0), self.all)[row]
            row, col = row[ok], col[ok]
        ok = self.ids[row] != qids[col]
        row, col = row[ok], col[ok]
        sim = np.empty(len(row), np.float32)
        for i in range(0, len(row), 65536):
            sim[i : i + 65536] = np.einsum("ij,ij->i", self.x[row[i : i + 65536]], q[col[i : i + 65536]])
        ok = sim >= low - ROUNDING
        return _best(qids[col[ok]], self.ids[row[ok]], sim[ok], k, both)

    def compare(self, queries: pd.DataFrame, k: int, low: float, both: bool) -> pd.DataFrame:
        """The same by products with all members of the queries' cells."""
        q, qids, reach = _from_bytes(queries["q"], queries["scale"]), queries["rid"].to_numpy(np.int64), queries["norm"].to_numpy(np.float32)
        wanted = self.centre_norms[:, None] - 2 * self.centres @ q.T <= reach[None, :] + 1e-4
        out = []
        for a, b, asks in zip(self.at, self.to, wanted):
            cols = np.flatnonzero(asks)
            step = max(1, ENTRIES // (b - a))
            for i in range(0, len(cols), step):
                some = cols[i : i + step]
                s = self.x[a:b] @ q[some].T
                r, w = np.divmod(np.flatnonzero(s >= low - ROUNDING), len(some))
                m, asked = self.ids[a + r], qids[some[w]]
                ok = m != asked
                out.append((asked[ok], m[ok], s[r[ok], w[ok]]))
        asked, m, s = (np.concatenate(z) for z in zip(*out)) if out else (qids[:0], self.ids[:0], np.zeros(0, np.float32))
        return _best(asked, m, s, k, both)


def _best(asked: np.ndarray, found: np.ndarray, s: np.ndarray, k: int, both: bool) -> pd.DataFrame:
    """(query_rid, rid, s): the k best found for each that asked, and what rounding may hide behind them; `both`: also the other way round."""
    if both:
        return pd.concat([_best(asked, found, s, k, False), _best(found, asked, s, k, False)])
    order = np.lexsort((found, -s, asked))
    asked, found, s = asked[order], found[order], s[order]
    start = np.searchsorted(asked, asked)
    last = s[np.minimum(start + k - 1, np.searchsorted(asked, asked, side="right") - 1)] if len(s) else s
    ok = s >= last - 2 * ROUNDING
    return pd.DataFrame({"query_rid": asked[ok], "rid": found[ok], "s": s[ok]})


def _best_columns(scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, row, score) of the `keep` largest finite entries of each row."""
    if keep < scores.shape[1]:
        top = np.argpartition(scores, scores.shape[1] - keep, axis=1)[:, -keep:]
    else:
        top = np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    row = np.repeat(np.arange(len(scores)), top.shape[1])
    column = top.ravel()
    score = scores[row, column]
    ok = np.isfinite(score)
    return column[ok], row[ok], score[ok]


def _expand(v: DataFrame, reps: DataFrame, near: DataFrame, k: int, query_filter: str | None, low: float) -> DataFrame:
    """Neighbours of classes of exact copies as neighbours of rows."""
    twins = reps.where("copies > 1").select("h1", "h2", "rid")
    doubled = v.select("id", "h1", "h2").join(twins, ["h1", "h2"]).select("id", "rid")
    w = Window.partitionBy("rid").orderBy("id")
    some = doubled.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")  # the k + 1 smallest ids of each class
    own = reps.where("copies > 1").select(F.col("rid").alias("query_rid"), "rid", F.lit(1.0).alias("similarity"))
    own = own.where(F.lit(low <= 1.0))
    lists = (
        near.unionByName(own)
        .join(some.withColumnRenamed("id", "member"), "rid", "left")
        .select("query_rid", F.coalesce("member", "rid").alias("neighbor_id"), "similarity")
    )
    b = Window.partitionBy("query_rid").orderBy(F.desc("similarity"), "neighbor_id")
    lists = lists.withColumn("r", F.row_number().over(b)).where(F.col("r") <= k + 1)
    lists = lists.groupBy("query_rid").agg(F.array_sort(F.collect_list(F.struct("r", "neighbor_id", "similarity"))).alias("near"))
    rows = reps.where("copies = 1").select(F.col("rid").alias("id"), "rid").unionByName(doubled)
    if query_filter:
        rows = rows.where(query_filter)
    return (
        rows.join(lists, rows["rid"] == lists["query_rid"])
        .select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("near", lambda s: s["neighbor_id"] != F.col("id")), 1, k)).alias("p", "s"))
        .where(F.col("s.similarity") >= low)
        .select("query_id", F.col("s.neighbor_id").alias("neighbor_id"), (F.col("p") + 1).alias("rank"), F.round("s.similarity", 6).alias("similarity"))
    )


def similar_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, min_similarity: float = 0.8, **how) -> DataFrame:
    """(a, b), a < b: pairs where one is among the k most similar of the other and the cosine is at least `min_similarity`."""
    near = knn(df, id_col, vec_col, k, min_similarity=min_similarity, **how)
    return near.select(F.least("query_id", "neighbor_id").alias("a"), F.greatest("query_id", "neighbor_id").alias("b")).distinct()


def exact_neighbors(df: DataFrame, id_col: str, vec_col: str, k: int, query_filter: str) -> DataFrame:
    """(query_id, neighbor_id, rank, similarity) by comparing a stated query set with all rows, in blocks."""
    v = unit_vectors(df, id_col, vec_col)
    v = materialize(v.select("id", unit(F.col("vec")).alias("emb")), "exact-vectors")
    queries, rows = v.where(query_filter).withColumnRenamed("id", "query_id"), v.withColumnRenamed("id", "unit_id")
    got = topk(queries, rows, k + 1).where("unit_id <> query_id")  # without the query itself
    w = Window.partitionBy("query_id").orderBy("rank")
    got = got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return got.select("query_id", F.col("unit_id").alias("neighbor_id"), "rank", F.round(F.least("score", F.lit(1.0)), 6).alias("similarity"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(n_exact, n_found, recall): how many exact neighbours were found; a neighbour as similar as the last exact one counts."""
    last = exact.groupBy("query_id").agg(F.min("similarity").alias("bound"), F.count(F.lit(1)).alias("n"))
    good = found.join(last, "query_id").where(F.col("similarity") >= F.col("bound") - 1e-6).groupBy("query_id").agg(F.count(F.lit(1)).alias("g"))
    both = last.join(good, "query_id", "left").select("n", F.least(F.coalesce("g", F.lit(0)), F.col("n")).alias("g"))
    return both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_exact"), F.coalesce(F.sum("g"), F.lit(0)).alias("n_found")).withColumn("recall", F.round(F.try_divide("n_found", "n_exact"), 4))
